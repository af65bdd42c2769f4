"""Ranks, positions, series and caps: what depends on the order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import join_alike
from ..functions.typed import mixed_key
from .lookups import carried, in_ranges, with_carried


def cumulated(counts: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """Rows of counts `_n` with `_before`: the sum of those ahead within `by`, in an order without ties.

    Summed up by ranges of (by, order), so no task sees a whole group; missing values of `by` are a group."""
    ranges = in_ranges(counts, [*by, order])
    over = carried(ranges, by, F.sum("_n"), "_over", added=True)
    inner = F.sum("_n").over(Window.partitionBy("_part", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0)
    return with_carried(ranges, over, by).withColumn("_before", F.coalesce(inner, zero) + F.coalesce("_over", zero)).drop("_part", "_over")


def _below(df: DataFrame, column: str, by: Sequence[str], ascending: bool) -> DataFrame:
    """(*by, column, _before): rows of better values within `by`, one row a value; blanks have no place."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    return cumulated(counts, by, F.asc(column) if ascending else F.desc(column)).select(*by, column, "_before")


def rank_eq(df: DataFrame, column: str, by: Sequence[str], ascending: bool = False, into: str = "rank") -> DataFrame:
    """1 + number of better values, within `by`; NULL for a blank."""
    ranked = _below(df, column, by, ascending).select(*by, column, (F.col("_before") + 1).cast("int").alias(into))
    return join_alike(df, ranked, [*by, column]).select(*df.columns, into)


def nth(df: DataFrame, column: str, k: int, by: Sequence[str], largest: bool = True) -> DataFrame:
    """k-th value with repeats; groups with fewer values are left out (#NUM!).

    The bound on the row number lets each task keep k rows a group before the shuffle."""
    order = F.desc(column) if largest else F.asc(column)
    w = Window.partitionBy(*by).orderBy(order)
    return df.filter(F.col(column).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).filter(F.col("_r") == k).select(*by, column)


def percent_rank(df: DataFrame, column: str, by: Sequence[str], into: str = "percent_rank") -> DataFrame:
    """Values below, over n - 1, blanks left out; 0 for a value alone."""
    share = F.when(F.col("_size") > 1, F.col("_before") / (F.col("_size") - 1)).otherwise(F.lit(0.0))
    below, size = _below(df, column, by, True), F.count(column).alias("_size")
    sized = join_alike(below, df.groupBy(*by).agg(size), by) if by else below.withColumn("_size", df.agg(size).scalar())
    ranked = sized.select(*by, column, share.alias(into))
    return join_alike(df, ranked, [*by, column]).select(*df.columns, into)


def extend_series(df: DataFrame, value: str, order_by: str, by: Sequence[str], n: int) -> DataFrame:
    """n values on from each series.  Two or more numbers go on by the average step, one number repeats;
    texts that end in digits count up and keep their width; other texts repeat in a cycle."""
    kind = dict(df.dtypes)[value]
    held = F.struct(F.col(value).alias("v"))
    kept = [F.min_by(held, order_by)["v"].alias("first"), F.max_by(held, order_by)["v"].alias("last"), F.count("*").alias("size")]
    if kind == "string":  # texts that repeat in a cycle are needed one by one
        kept.append(F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v")))).alias("s"))
    ahead = df.groupBy(*by).agg(*kept).withColumn("step_no", F.explode(F.sequence(F.lit(1), F.lit(n))))
    size, first, last = F.col("size"), F.col("first"), F.col("last")
    if kind == "date":
        step = F.when(size > 1, F.round(F.datediff(last, first) / F.nullif(size - 1, F.lit(0)))).otherwise(F.lit(1)).cast("int")
        out = F.date_add(last, step * F.col("step_no"))
    elif kind == "string":
        digits = F.regexp_extract(last, r"([0-9]+)$", 1)
        stem = F.substring(last, F.lit(1), F.length(last) - F.length(digits))
        count = (digits.try_cast("bigint") + F.col("step_no")).cast("string")
        counted = F.concat(stem, F.when(F.length(count) < F.length(digits), F.lpad(count, F.length(digits), F.lit("0"))).otherwise(count))
        out = F.when(digits != "", counted).otherwise(F.get("s", F.pmod(F.col("step_no") - 1, size).cast("int"))["v"])
    else:
        step = F.when(size > 1, (last - first) / F.nullif(size - 1, F.lit(0))).otherwise(F.lit(0.0))
        out = last + step * F.col("step_no")
    return ahead.select(*by, "step_no", out.alias(value))


def sort_rows(df: DataFrame, keys: Sequence[tuple[str, bool]], order_by: str, locale: str | None = "ko") -> DataFrame:
    """Whole rows by (column, ascending); blanks last both ways; ties keep their order.

    Texts are in the order of the locale's alphabet (Korean by default; None: by code point)."""
    texts = {c for c, kind in df.dtypes if kind == "string" and locale}
    place = lambda c: F.collate(F.col(c), locale) if c in texts else F.col(c)
    order = [F.asc_nulls_last(place(c)) if up else F.desc_nulls_last(place(c)) for c, up in keys]
    return df.orderBy(*order, order_by)


def sort_values(df: DataFrame, number: str, text: str, order_by: str, ascending: bool = True) -> DataFrame:
    """Mixed values: numbers before text, text without case; ties keep their order."""
    key = mixed_key(F.col(number), F.col(text))
    return df.orderBy(F.asc(key) if ascending else F.desc(key), order_by)


def top_k(df: DataFrame, column: str, k: int, tie: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the k largest values."""
    if not by:
        return df.orderBy(F.desc_nulls_last(column), tie).limit(k)
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(column), tie)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def cap_rows(df: DataFrame, by: Sequence[str], n: int, order_by: str) -> DataFrame:
    """The first n rows of each key, with `left_out`: how many more there were."""
    w = Window.partitionBy(*by).orderBy(order_by)
    kept = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    sizes = df.groupBy(*by).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("left_out"))
    return join_alike(kept, sizes, by)


def unique_values(df: DataFrame, key: Column, order_by: str) -> DataFrame:
    """The first row of each key; give a key without case to compare texts so.  Select the columns wanted first: all are carried."""
    packed = F.struct(*df.columns)
    return df.groupBy(key.alias("_k")).agg(F.min_by(packed, order_by).alias("_row")).select("_row.*")


def slug_dedupe(df: DataFrame, slug: str, by: Sequence[str], order_by: str, into: str = "anchor") -> DataFrame:
    """The second equal slug gets -2, the third -3."""
    w = Window.partitionBy(*by, slug).orderBy(order_by)
    n = F.row_number().over(w)
    return df.withColumn(into, F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string"))))
