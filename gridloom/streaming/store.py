"""A table of cells kept up to date by batches of changes: keyed merge, tombstones, replays without effect.

Layout below a target folder, which all executors must share:

    cells/batch=<id>/bucket=<b>      all cells of a bucket of sheets as of a batch
    profiles/batch=<id>/bucket=<b>   what is derived from them
    commits/                         one file a batch: the buckets it rewrote

A sheet lives in one bucket, by hash.  A batch reads the touched buckets only, merges by key, writes
them anew below its own id and commits last, by one small file that appears whole or not
at all; readers follow the newest committed batch of each bucket.  So a batch that died half way
is invisible and is written again, and a batch id that is already committed changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHEET = ["project_id", "sheet_id"]
CELL = [*SHEET, "row", "col"]
#: Buckets of sheets: touched ones are rewritten whole.
BUCKETS = 64
COMMIT = "batch bigint, bucket int"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, target: str) -> DataFrame:
    """(batch, bucket) of all committed batches."""
    path = f"{target}/commits"
    return spark.read.schema(COMMIT).parquet(path) if _there(spark, path) else spark.createDataFrame([], COMMIT)


def current(spark: SparkSession, target: str) -> dict[int, int]:
    """The newest committed batch of each bucket: BUCKETS entries at most."""
    return {r["bucket"]: r["batch"] for r in commits(spark, target).groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _read(spark: SparkSession, target: str, kind: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [p for b, n in sorted(versions.items()) if _there(spark, p := f"{target}/{kind}/batch={n}/bucket={b}")]
    if not paths:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema else spark.read).parquet(*paths)


def stored(spark: SparkSession, target: str, kind: str = "cells", schema=None) -> DataFrame:
    """The table as last committed: `cells` without deleted ones, or `profiles`.  A schema is needed while nothing is stored."""
    rows = _read(spark, target, kind, current(spark, target), schema)
    return rows.filter("NOT deleted").drop("deleted") if kind == "cells" and "deleted" in rows.columns else rows


def upsert(before: DataFrame, changes: DataFrame, keys: Sequence[str] = CELL, order_by: Sequence[str] = ()) -> DataFrame:
    """One row a key: the one of the greatest `order_by`, the change where equal (or nothing orders them), the greater text of two changes.

    Keys compare null-safe.  Rows are aggregated by key before and after one shuffle; no join."""
    values = [c for c in before.columns if c not in keys]
    packed = F.struct(*values)
    rows = before.withColumn("_new", F.lit(False)).unionByName(changes.select(*before.columns).withColumn("_new", F.lit(True)))
    rank = F.struct(*[F.col(c) for c in order_by], F.col("_new"), F.when(F.col("_new"), F.to_json(packed)))
    return rows.groupBy(*keys).agg(F.max_by(packed, rank).alias("_v")).select(*keys, "_v.*").select(*before.columns)


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in SHEET]), F.lit(buckets)).cast("int")


def merge_batch(changes: DataFrame, batch: int, profile: Callable[[DataFrame], DataFrame], target: str, order_by: Sequence[str] = (), buckets: int = BUCKETS) -> bool:
    """Merge a batch of cells into the stored table; False if this batch id was committed before.

    changes(project_id, sheet_id, row, col, ..., deleted boolean if cells can go).  A deleted cell stays as a
    tombstone, so that an older change that comes later does not bring it back."""
    spark = changes.sparkSession
    if not commits(spark, target).filter(F.col("batch") == batch).isEmpty():
        return False
    if "deleted" not in changes.columns:
        changes = changes.withColumn("deleted", F.lit(False))
    changes = changes.withColumn("deleted", F.coalesce("deleted", F.lit(False))).persist()
    try:
        touched = sorted(r[0] for r in changes.select(bucket_of(buckets)).distinct().collect())
        known = current(spark, target)
        versions = {b: known[b] for b in touched if b in known}
        before = _read(spark, target, "cells", versions, changes.schema)
        upsert(before, changes, CELL, order_by).withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/cells/batch={batch}")
        merged = _read(spark, target, "cells", dict.fromkeys(touched, batch), changes.schema)
        sheets = changes.select(*SHEET).distinct()
        same = [merged[c].eqNullSafe(sheets[c]) for c in SHEET]
        fresh = profile(merged.filter("NOT deleted").join(sheets, same, "left_semi").drop("deleted"))
        old = _read(spark, target, "profiles", versions, fresh.schema)
        kept = old.join(sheets, [old[c].eqNullSafe(sheets[c]) for c in SHEET], "left_anti")
        kept.unionByName(fresh).withColumn("bucket", bucket_of(buckets)).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/profiles/batch={batch}")
        done = spark.createDataFrame([(batch, b) for b in touched], COMMIT).coalesce(1)
        done.write.mode("append").parquet(f"{target}/commits")
    finally:
        changes.unpersist()
    return True


def vacuum(spark: SparkSession, target: str) -> int:
    """Delete versions of buckets that no reader of the newest state needs, and batches never committed; their number.

    Only while no batch is being merged."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf, newest, gone = spark._jsc.hadoopConfiguration(), current(spark, target), 0
    for kind in ("cells", "profiles"):
        at = fs.Path(f"{target}/{kind}")
        store = at.getFileSystem(conf)
        for folder in store.listStatus(at) if store.exists(at) else []:
            batch = int(folder.getPath().getName().split("=")[1])
            for part in store.listStatus(folder.getPath()):
                name = part.getPath().getName()
                if name.startswith("bucket=") and newest.get(int(name.split("=")[1])) != batch:
                    gone += store.delete(part.getPath(), True)
    return gone


def stream_cells(changes: DataFrame, profile: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, order_by: Sequence[str] = (), buckets: int = BUCKETS):
    """Start a query that merges a stream of changed cells into `target`; `profile(cells)` gives the rows to keep
    per project and sheet, with both columns.  Sheets of one id in two projects are two sheets.

    Batch ids come from the checkpoint folder, so it and the target belong together."""

    def refresh(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, profile, target, order_by, buckets)

    return changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
