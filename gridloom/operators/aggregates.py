"""Grouped aggregates with spreadsheet rules; each returns a Column for `groupBy(...).agg(...)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import join_alike
from ..functions.typed import to_number
from . import orderstats


def total(x: Column) -> Column:
    """Empty gives 0."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def average(x: Column) -> Column:
    """Empty is NULL (#DIV/0!)."""
    return F.avg(x)


def smallest(x: Column) -> Column:
    return F.coalesce(F.min(x), F.lit(0.0))


def largest(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0.0))


def count_numbers(x: Column) -> Column:
    return F.count(x)


def count_filled(x: Column) -> Column:
    return F.count_if(x.isNotNull() & (x.cast("string") != ""))


def count_blank(x: Column) -> Column:
    return F.count_if(x.isNull() | (x.cast("string") == ""))


def product(x: Column) -> Column:
    """Empty gives 0."""
    return F.when(F.count(x) == 0, F.lit(0.0)).otherwise(F.product(x))


def sum_squares(x: Column) -> Column:
    return total(x * x)


def sumproduct(*columns: Column) -> Column:
    """Sum of row products; blanks count as 0, booleans as 1 and 0."""
    out = F.lit(1.0)
    for c in columns:
        out = out * F.coalesce(c.cast("double"), F.lit(0.0))
    return total(out)


def where(x: Column, test: Column) -> Column:
    return F.when(test, x)


def sumif(x: Column, test: Column) -> Column:
    """Text in the summed column is skipped."""
    return total(where(x, test))


def countif(test: Column) -> Column:
    return F.count_if(test)


def averageif(x: Column, test: Column) -> Column:
    return F.avg(where(x, test))


def _all(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def sumifs(x: Column, *tests: Column, text: bool = False) -> Column:
    """All criteria true; with text=True the column is text and its numbers are added."""
    return total(where(to_number(x) if text else x, _all(tests)))


def countifs(*tests: Column) -> Column:
    return F.count_if(_all(tests))


def averageifs(x: Column, *tests: Column) -> Column:
    return F.avg(where(x, _all(tests)))


def maxifs(x: Column, *tests: Column) -> Column:
    return largest(where(x, _all(tests)))


def minifs(x: Column, *tests: Column) -> Column:
    return smallest(where(x, _all(tests)))


def percentile(x: Column, p: float, approximate: int | None = None) -> Column:
    """Linear interpolation at p (n - 1); with `approximate` (an accuracy) a bounded-memory sketch."""
    return F.percentile(x, F.lit(p)) if approximate is None else F.percentile_approx(x, p, approximate)


def quartile(x: Column, q: int) -> Column:
    return percentile(x, q / 4)


def median(x: Column) -> Column:
    return F.median(x)


def deviation_squares(x: Column) -> Column:
    return F.var_pop(x) * F.count(x)


def geomean(x: Column) -> Column:
    """NULL (#NUM!) unless all are positive."""
    return F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.log(x)))))


def harmean(x: Column) -> Column:
    return F.when(F.min(x) > 0, F.count(x) / F.sum(F.try_divide(F.lit(1.0), x)))


def avedev(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean distance from the mean: two passes joined by group."""
    means = df.groupBy(*by).agg(F.avg(column).alias("_mean"))
    joined = join_alike(df, means, by) if by else df.withColumn("_mean", means.scalar())
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(column) - F.col("_mean"))).alias("avedev"))


def mode(df: DataFrame, column: str, order_by: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value of those that repeat, ties to the one seen first; NULL (#N/A) if none repeats."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"), F.min(order_by).alias("_first"))
    rank = F.struct(F.col("_n"), (-F.col("_first").cast("double")))
    return counts.groupBy(*by).agg(F.max_by(F.when(F.col("_n") > 1, F.col(column)), F.when(F.col("_n") > 1, rank)).alias("mode"))


def trimmean(df: DataFrame, column: str, share: float, by: Sequence[str]) -> DataFrame:
    """Mean without floor(n share / 2) values at each end."""
    return orderstats.trimmean(df, column, share, by)


def pairwise(y: Column, x: Column) -> tuple[Column, Column]:
    """Both sides only where both are numbers."""
    both = y.isNotNull() & x.isNotNull()
    return F.when(both, y), F.when(both, x)


def correl(y: Column, x: Column) -> Column:
    a, b = pairwise(y, x)
    return F.when((F.count(a) >= 2) & (F.var_pop(a) > 0) & (F.var_pop(b) > 0), F.corr(a, b))


def rsq(y: Column, x: Column) -> Column:
    return F.pow(correl(y, x), 2)


def slope(y: Column, x: Column) -> Column:
    return F.regr_slope(y, x)


def intercept(y: Column, x: Column) -> Column:
    return F.regr_intercept(y, x)


def forecast(at: Column | float, y: Column, x: Column) -> Column:
    point = at if isinstance(at, Column) else F.lit(float(at))
    return intercept(y, x) + slope(y, x) * point


def subtotal(code: int, x: Column, skip_error: Column | None = None, k: float | None = None) -> Column:
    """Function by number: 1 to 11, and 12 to 17 of the wider form; `skip_error` is the error column to leave out.

    13 is the most frequent value that occurs twice or more, of several the smallest (`mode_first_seen`
    takes an order instead).  12 and 14 to 17 gather a group's values; `orderstats.subtotal` does not."""
    v = x if skip_error is None else F.when(skip_error.isNull(), x)
    table = {
        1: lambda: average(v), 2: lambda: count_numbers(v), 3: lambda: count_filled(v), 4: lambda: largest(v), 5: lambda: smallest(v),
        6: lambda: product(v), 7: lambda: F.stddev_samp(v), 8: lambda: F.stddev_pop(v), 9: lambda: total(v), 10: lambda: F.var_samp(v), 11: lambda: F.var_pop(v),
        12: lambda: median(v), 13: lambda: F.when(F.count(v) > F.count_distinct(v), F.mode(v, True)), 14: lambda: F.get(F.sort_array(F.collect_list(v), asc=False), F.lit(int(k or 1) - 1)), 15: lambda: F.get(F.sort_array(F.collect_list(v)), F.lit(int(k or 1) - 1)),
        16: lambda: percentile(v, float(k or 0)), 17: lambda: quartile(v, int(k or 0)),
    }
    return table[code % 100]()


def _gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers of at least 0: 90 steps of Euclid cover every long."""
    zero = F.lit(0).cast("bigint")
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], zero)).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), F.struct(a.alias("a"), b.alias("b")), step, lambda s: s["a"])


def whole_quotient(a: Column, b: Column) -> Column:
    """a div b of whole numbers; doubles would round large ones."""
    return F.call_function("div", a, b)


def _folds(values: Column) -> tuple[Column, Column]:
    """GCD and LCM of an array of whole numbers: of none 0, LCM 0 with a 0 among them and NULL beyond the range of long."""
    zero = F.lit(0).cast("bigint")
    # once beyond long an LCM stays there: NULL goes through the rest of the fold
    lcm = F.aggregate(F.filter(values, lambda v: v > 0), F.lit(1).cast("bigint"), lambda a, v: F.try_multiply(a, whole_quotient(v, _gcd(a, v))))
    return F.aggregate(values, zero, _gcd), F.when((F.size(values) == 0) | F.array_contains(values, zero), zero).otherwise(lcm)


def gcd_lcm(x: Column) -> tuple[Column, Column]:
    """Over the distinct whole numbers of a group; any negative gives NULL (#NUM!), an empty list 0.

    The numbers of a group meet in one task; `gcd_lcm_of` folds them where they are."""
    ok = F.coalesce(F.min(x), F.lit(0.0)) >= 0
    gcd, lcm = _folds(F.collect_set(F.floor(x).cast("bigint")))
    return F.when(ok, gcd), F.when(ok, lcm)


def gcd_lcm_of(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, gcd, lcm): the same for groups of any size.

    Both can be folded in parts: first the numbers of each partition, then one value a partition and group."""
    spread = df.withColumn("_part", F.spark_partition_id()).groupBy(*by, "_part").agg(F.collect_set(F.floor(F.col(column)).cast("bigint")).alias("_set"), F.min(column).alias("_least"))
    there = F.size("_set") > 0
    first = _folds(F.col("_set"))
    parts = spread.select(*by, "_least", F.when(there, first[0]).alias("_gcd"), F.when(there, first[1]).alias("_lcm"), there.alias("_there"))
    whole = parts.groupBy(*by).agg(F.collect_list("_gcd").alias("_g"), F.collect_list("_lcm").alias("_l"), F.count_if("_there").alias("_n"), F.min("_least").alias("_least"))
    zero = F.lit(0).cast("bigint")
    gcd, lcm = _folds(F.col("_g"))[0], _folds(F.col("_l"))[1]
    # a part whose LCM is beyond long is missing from the list
    known = F.when((F.col("_n") == 0) | F.array_contains("_l", zero), zero).when(F.size("_l") == F.col("_n"), lcm)
    ok = F.coalesce(F.col("_least"), F.lit(0)) >= 0
    return whole.select(*by, F.when(ok, gcd).alias("gcd"), F.when(ok, known).alias("lcm"))


def textjoin(x: str, order_by: str, separator: str = ",", skip_blank: bool = True) -> Column:
    """Texts of a group joined in order."""
    value = F.coalesce(F.col(x).cast("string"), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order_by).alias("o"), value.alias("v"))))
    texts = F.transform(rows, lambda r: r["v"])
    return F.array_join(F.filter(texts, lambda t: t != "") if skip_blank else texts, separator)


def npv(df: DataFrame, rate: float, amount: str, order_by: str, by: Sequence[str]) -> DataFrame:
    """Sum of amounts, the i-th in order divided by (1 + rate)^i; of equal `order_by` the smaller amount comes first.

    Places are counted by ranges, so a group of any size is spread over tasks."""
    placed = orderstats.numbered(df.filter(F.col(amount).isNotNull()).select(*by, order_by, amount), by, [order_by, amount], "_i")
    return placed.groupBy(*by).agg(F.sum(F.col(amount) / F.pow(F.lit(1.0 + rate), F.col("_i"))).alias("npv"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row a column: type, count, nulls, and sum, average, smallest and largest of numbers.

    One aggregation over the table, then the single row is turned into rows."""
    kinds = dict(df.dtypes)
    number = {c: kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint") or kinds[c].startswith("decimal") for c in df.columns}
    blank = F.lit(None).cast("double")
    sums = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        v = x.cast("double")
        sums.append(F.struct(F.lit(c).alias("column"), F.lit("number" if number[c] else "date" if kinds[c] in ("date", "timestamp", "timestamp_ntz") else "text").alias("type"), F.count(x).alias("filled"), F.count_if(x.isNull()).alias("blank"), *[(f(v) if number[c] else blank).alias(n) for n, f in (("sum", F.sum), ("average", F.avg), ("smallest", F.min), ("largest", F.max))]).alias(f"c{i}"))
    one = df.agg(*sums)
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))


def fold_series(df: DataFrame, series: str, order_by: str, value: str, by: Sequence[str], keep: int = 8, rest: str = "기타") -> DataFrame:
    """More than `keep` series: the first keep - 1 stay, the others are added up; missing counts as 0."""
    first = df.groupBy(series).agg(F.min(order_by).alias("_first"))
    ranked = first.orderBy("_first", series).limit(keep + 1)
    numbered = ranked.withColumn("_no", F.row_number().over(Window.orderBy("_first", series)))  # keep + 1 rows at most
    many = ranked.agg(F.count("*") > keep)
    kept = numbered.withColumn("_many", many.scalar()).filter(~F.col("_many") | (F.col("_no") < keep)).select(series, F.lit(True).alias("_kept"))
    named = join_alike(df, F.broadcast(kept), [series]).withColumn(series, F.when(F.col("_kept"), F.col(series)).otherwise(F.lit(rest)))
    return named.groupBy(*by, series).agg(F.sum(F.coalesce(F.col(value), F.lit(0.0))).alias(value))
