"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Separator class of the word rule: a word is a run of other characters.
SEPARATORS = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SEPARATORS}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the session; on one machine, where it names none, one of our own."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        return folder.get()
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named and context.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or f"/tmp/gridloom-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


#: Tables written by `materialise` in this process.
WRITTEN: list[str] = []


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far, once no frame made from them is needed any more; their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(WRITTEN.pop()) for _ in range(len(WRITTEN))]
    return sum(path.getFileSystem(conf).delete(path, True) for path in paths)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that this process no longer uses goes back to the system, where the C library can do so.

    The driver's Python makes many small arrays at once when it fits; their room would else stay with it to the end."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_part(id_column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a small number: the stated hold-out rule."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def set_apart(row_id: int, one_in: int, salt: str) -> bool:
    """Whether a fitting row is kept for calibration: about one row in `one_in`, whatever the ids look like."""
    return zlib.crc32(f"{salt}:{row_id}".encode()) % one_in == 0


def sampled(df: DataFrame, rows: int, available: int, *key: str) -> DataFrame:
    """About `rows` of `available` rows, chosen by a hash of `key`, the same on every run."""
    if available <= rows:
        return df
    share = int(rows / available * 1_000_000)
    return df.filter(F.pmod(F.xxhash64(*[F.col(k) for k in key], F.lit("sample")), F.lit(1_000_000)) < share)


def named(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{column}`")


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, by which rows of equal key are put in order; columns that hold maps or variants have no hash and are left out."""
    whole = [named(f.name) for f in df.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
    return F.xxhash64(*whole) if whole else F.lit(0).cast("bigint")


def with_text_columns(df: DataFrame, text: str, new: str, compute: Callable[[], Callable], keep: Sequence[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) plus the columns `new` (DDL) computed from whole texts.

    `compute()` is called once a task; what it returns maps a batch's texts (bytes or
    None) to one sequence per new column.  New columns replace kept ones of the same name."""
    fields = T.StructType.fromDDL(new).fields
    clash = {f.name for f in fields}
    names = [c for c in (df.columns if keep is None else keep) if c not in clash]
    inner = [f"k{i}" for i in range(len(names))]
    cut = df.select(*[named(c).alias(k) for c, k in zip(names, inner)], *([] if text in names else [named(text).alias("t")]))
    at = names.index(text) if text in names else len(names)
    schema = T.StructType([*[T.StructField(k, cut.schema[k].dataType) for k in inner], *[T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields)]])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = compute()
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            made = [pa.array(x, kind) for x, kind in zip(ready(texts), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(inner))), *made], names=schema.names)

    out = cut.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, inner)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(fields)])
