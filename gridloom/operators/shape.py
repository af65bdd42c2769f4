"""Shape: union, transpose, sequences, long and wide tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LARGEST_SEQUENCE = 100_000


def union_sheets(sheets: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def transpose_cells(cells: DataFrame) -> DataFrame:
    """Rows become columns; other columns stay."""
    return cells.select(*[F.col({"row": "col", "col": "row"}.get(c, c)).alias(c) for c in cells.columns])


def transpose_table(df: DataFrame, names: str, columns: Sequence[str], headers: Sequence[str]) -> DataFrame:
    """Values of `names` become columns (`headers`), `columns` become rows."""
    long = df.unpivot([names], list(columns), "column", "value")
    return long.groupBy("column").pivot(names, list(headers)).agg(F.first("value"))


def sequence_table(spark: SparkSession, rows: int, columns: int = 1, start: float = 1, step: float = 1) -> DataFrame:
    """(row, col, value) counted row by row; more than 100,000 values are refused."""
    if rows * columns > LARGEST_SEQUENCE or rows < 1 or columns < 1:
        raise ValueError("#NUM!: sequence size")
    n = F.col("id")
    return spark.range(rows * columns).select((F.floor(n / columns) + 1).cast("int").alias("row"), (n % columns + 1).cast("int").alias("col"), (F.lit(float(start)) + n * float(step)).alias("value"))


def to_cells(df: DataFrame, order_by: Sequence[str], sheet_id: str, project_id: str = "p") -> DataFrame:
    """A wide table as sparse cells with a header in row 1; blanks give no cell."""
    from .cells import column_name
    from .lookups import positions

    kinds = dict(df.dtypes)
    placed = positions(df, order_by)
    numeric = lambda c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal")
    cell = lambda c, i: F.struct(
        F.lit(i).alias("col"),
        (F.col(c).cast("double") if numeric(c) else F.lit(None).cast("double")).alias("v_num"),
        (F.lit(None).cast("string") if numeric(c) or kinds[c] == "boolean" else F.col(c).cast("string")).alias("v_str"),
        (F.col(c) if kinds[c] == "boolean" else F.lit(None).cast("boolean")).alias("v_bool"),
        F.lit("n" if numeric(c) else "b" if kinds[c] == "boolean" else "s").alias("t"),
        F.col(c).isNotNull().alias("filled"),
    )
    body = placed.select((F.col("position") + 1).cast("int").alias("row"), F.explode(F.array(*[cell(c, i + 1) for i, c in enumerate(df.columns)])).alias("c")).filter("c.filled").select("row", "c.col", "c.v_num", "c.v_str", "c.v_bool", "c.t")
    head = df.sparkSession.createDataFrame([(1, i + 1, c) for i, c in enumerate(df.columns)], "row int, col int, v_str string")
    head = head.select("row", "col", F.lit(None).cast("double").alias("v_num"), "v_str", F.lit(None).cast("boolean").alias("v_bool"), F.lit("s").alias("t"))
    every = head.unionByName(body)
    return every.select(
        F.lit(project_id).alias("project_id"), F.lit(sheet_id).alias("sheet_id"), "row", "col",
        F.concat(column_name(F.col("col")), F.col("row").cast("string")).alias("ref"),
        F.lit(None).cast("string").alias("f"), "v_num", "v_str", "v_bool", "t", F.lit(None).cast("string").alias("fmt"),
        F.lit(None).cast("map<string,string>").alias("style"),
    )


def to_table(cells: DataFrame, columns: Sequence[str], header_row: int = 1) -> DataFrame:
    """Cells as a wide table of text, one row a sheet row below the header; `columns` name columns 1, 2, ..."""
    from .cells import shown

    body = cells.filter(F.col("row") > header_row).withColumn("_v", shown())
    wide = body.groupBy("sheet_id", "row").pivot("col", list(range(1, len(columns) + 1))).agg(F.first("_v"))
    return wide.select("sheet_id", "row", *[F.col(f"`{i + 1}`").alias(c) for i, c in enumerate(columns)])
