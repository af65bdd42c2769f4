"""Exact order statistics of groups of any size: percentiles, k-th values, trimmed means.

Values are counted per group, the counts are summed up over ranges of (group, value), and a k-th value is the
one whose span of places holds k.  So no group meets in one task, however many rows or distinct
values it has; a range needs the memory of its own counts only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import join_alike
from ..functions.lineage import pinned
from .lookups import carried, in_ranges, with_carried
from .ordered import cumulated


def spans(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """(*by, column, _n, _before, _size): each distinct value with its number, the number below it and the group's.

    Blanks have no place; missing values of `by` are a group."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    placed = pinned(cumulated(counts, by, F.asc(column)))
    sizes = placed.groupBy(*by).agg(F.sum("_n").alias("_size"))
    if not by:
        return placed.withColumn("_size", sizes.scalar())
    return join_alike(placed, sizes, by)


def numbered(df: DataFrame, by: Sequence[str], order_by: Sequence[str], into: str) -> DataFrame:
    """Adds the place of each row within `by`, from 1 on: counted inside ranges of (by, order_by) and carried over between them."""
    ranges = in_ranges(df, [*by, *order_by])
    over = carried(ranges, by, F.count("*"), "_over", added=True)
    inner = F.row_number().over(Window.partitionBy("_part", *by).orderBy(*order_by))
    return with_carried(ranges, over, by).withColumn(into, F.coalesce("_over", F.lit(0)) + inner).drop("_part", "_over")


def at(place: Column, column: str) -> Column:
    """Aggregate: the value at a place counted from 0."""
    return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col(column)))


def quantiles(df: DataFrame, column: str, shares: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, one column a share): linear interpolation at p (n - 1), as `aggregates.percentile` gives.

    A group without values has no row; a share outside 0 to 1 is NULL (#NUM!)."""
    found, made = [], []
    for i, (name, p) in enumerate(shares.items()):
        place = F.lit(float(p)) * (F.col("_size") - 1)
        if not 0 <= p <= 1:
            made.append(F.lit(None).cast("double").alias(name))
            continue
        low = F.floor(place)
        found += [at(low, column).cast("double").alias(f"_l{i}"), at(F.ceil(place), column).cast("double").alias(f"_h{i}"), F.max(place - low).alias(f"_w{i}")]
        made.append((F.col(f"_l{i}") + F.col(f"_w{i}") * (F.col(f"_h{i}") - F.col(f"_l{i}"))).alias(name))
    sized = spans(df, column, by).groupBy(*by).agg(F.max("_size").alias("_size"), *found)
    return sized.filter("_size IS NOT NULL").select(*by, *made)


def kth(df: DataFrame, column: str, k: int, by: Sequence[str] = (), largest: bool = True) -> DataFrame:
    """(*by, column): the k-th value with repeats, from the largest or the smallest; groups of fewer values are left out (#NUM!)."""
    place = F.col("_size") - k if largest else F.lit(k - 1)
    held = (F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")) & (F.lit(k) >= 1)
    return spans(df, column, by).filter(held).select(*by, column)


def trimmean(df: DataFrame, column: str, share: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean without floor(n share / 2) values at each end: a value counts as often as its places lie between the cuts."""
    cut = F.floor(F.col("_size") * share / 2)
    kept = F.greatest(F.lit(0), F.least(F.col("_before") + F.col("_n"), F.col("_size") - cut) - F.greatest(F.col("_before"), cut))
    weighed = spans(df, column, by).withColumn("_kept", kept)
    return weighed.groupBy(*by).agg((F.sum(F.col(column) * F.col("_kept")) / F.nullif(F.sum("_kept"), F.lit(0))).alias("trimmean"))


def subtotal(df: DataFrame, code: int, column: str, by: Sequence[str] = (), k: float = 1, into: str = "subtotal") -> DataFrame:
    """The subtotal codes that need an order (12 median, 14 k-th largest, 15 k-th smallest, 16 percentile, 17 quartile), by ranges."""
    code %= 100
    if code in (14, 15):
        return kth(df, column, int(k), by, code == 14).withColumnRenamed(column, into)
    share = {12: 0.5, 16: float(k), 17: k / 4}[code]
    return quantiles(df, column, {into: share}, by)
