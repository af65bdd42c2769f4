"""Loans, depreciation, cash flows and business days as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1.0 + rate, n)


def _annuity(rate: Column, n: Column, due: Column) -> Column:
    """What one payment a period grows to after n periods; due 1 pays at the start."""
    return F.when(rate == 0, n.cast("double")).otherwise((1.0 + rate * due) * (_growth(rate, n) - 1.0) / F.nullif(rate, F.lit(0.0)))


def pmt(rate: Column, n: Column, pv: Column, fv: Column | float = 0.0, due: Column | int = 0) -> Column:
    """Payment a period, outflow negative."""
    fv, due = (x if isinstance(x, Column) else F.lit(x) for x in (fv, due))
    return -(pv * _growth(rate, n) + fv) / _annuity(rate, n, due)


def future_value(rate: Column, n: Column, payment: Column, pv: Column | float = 0.0, due: Column | int = 0) -> Column:
    pv, due = (x if isinstance(x, Column) else F.lit(x) for x in (pv, due))
    return -(pv * _growth(rate, n) + payment * _annuity(rate, n, due))


def present_value(rate: Column, n: Column, payment: Column, fv: Column | float = 0.0, due: Column | int = 0) -> Column:
    fv, due = (x if isinstance(x, Column) else F.lit(x) for x in (fv, due))
    return -(fv + payment * _annuity(rate, n, due)) / _growth(rate, n)


def periods(rate: Column, payment: Column, pv: Column, fv: Column | float = 0.0, due: Column | int = 0) -> Column:
    """NULL (#NUM!) where no number of periods fits."""
    fv, due = (x if isinstance(x, Column) else F.lit(x) for x in (fv, due))
    k = payment * (1.0 + rate * due) / F.nullif(rate, F.lit(0.0))
    ratio = (k - fv) / F.nullif(k + pv, F.lit(0.0))
    return F.when(rate == 0, -(pv + fv) / F.nullif(payment, F.lit(0.0))).when(ratio > 0, F.log(ratio) / F.log(1.0 + rate))


def interest_part(rate: Column, period: Column, n: Column, pv: Column, fv: Column | float = 0.0, due: Column | int = 0) -> Column:
    """Interest of one period; outside 1 .. n NULL (#NUM!)."""
    due_c = due if isinstance(due, Column) else F.lit(due)
    payment = pmt(rate, n, pv, fv, due)
    balance = future_value(rate, period - 1, payment, pv, due)
    interest = F.when((due_c == 1) & (period == 1), F.lit(0.0)).when(due_c == 1, (balance - payment) * rate).otherwise(balance * rate)
    return F.when((period >= 1) & (period <= n), interest)


def loan_schedule(loans: DataFrame) -> DataFrame:
    """loans(loan_id, rate, nper, pv, fv, due) -> payment, interest, principal and balance of each period."""
    c = F.col
    each = loans.withColumn("period", F.explode(F.sequence(F.lit(1), c("nper"))))
    payment = pmt(c("rate"), c("nper"), c("pv"), c("fv"), c("due"))
    interest = interest_part(c("rate"), c("period"), c("nper"), c("pv"), c("fv"), c("due"))
    balance = -future_value(c("rate"), c("period"), payment, c("pv"), c("due"))
    return each.select("loan_id", "period", payment.alias("payment"), interest.alias("interest"), (payment - interest).alias("principal"), balance.alias("balance"))


def depreciation_schedule(assets: DataFrame) -> DataFrame:
    """assets(asset_id, cost, salvage, life, factor) -> straight line, sum of years, declining balance by period."""
    c = F.col
    each = assets.withColumn("period", F.explode(F.sequence(F.lit(1), c("life"))))
    years = c("life") * (c("life") + 1) / 2
    keep = F.greatest(1.0 - c("factor") / c("life"), F.lit(0.0))
    book = lambda k: F.greatest(c("cost") * F.pow(keep, k), F.least(c("salvage"), c("cost")))
    return each.select(
        "asset_id", "period", ((c("cost") - c("salvage")) / c("life")).alias("sln"),
        ((c("cost") - c("salvage")) * (c("life") - c("period") + 1) / years).alias("syd"),
        F.greatest(book(c("period") - 1) - book(c("period")), F.lit(0.0)).alias("ddb"),
    )


def _values(flows: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Worth of each row of flows at its rate, and the slope: discounted to the first flow, or below a rate of 0
    compounded to the last one, which has the same sign and root and does not overflow."""
    below = r < 0
    x = np.where(below, 1 + r, 1 / (1 + r))
    f, d = np.zeros(len(r)), np.zeros(len(r))
    for k in range(flows.shape[1]):
        d = d * x + f
        f = f * x + np.where(below, flows[:, k], flows[:, -1 - k])
    return f, np.where(below, d, -d * x * x)


def _rates(flows: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rates of series of one length, a row each: Newton steps kept inside a bracket that bisection narrows; NaN where there is none."""
    a, b = np.full(len(flows), low), np.full(len(flows), high)
    fa, fb = (np.sign(_values(flows, x)[0]) for x in (a, b))
    out = np.where(fa == 0, a, np.where(fb == 0, b, np.nan))
    live = np.flatnonzero(fa * fb < 0)
    r = np.full(len(flows), 0.1)
    for _ in range(200):
        if not len(live):
            break
        f, slope = _values(flows[live], r[live])
        same = np.sign(f) == fa[live]
        a[live[same]], b[live[~same]] = r[live[same]], r[live[~same]]
        step = r[live] - f / slope
        new = np.where((a[live] < step) & (step < b[live]), step, (a[live] + b[live]) / 2)
        ended = (f == 0) | (np.abs(new - r[live]) < 1e-13)
        r[live] = np.where(f == 0, r[live], new)
        out[live] = r[live]
        live = live[~ended]
    return out


def solve_rates(series: Sequence[Sequence[float]], low: float = -0.999999, high: float = 10.0) -> np.ndarray:
    """The rate at which each series of flows from time 0 on discounts to 0, those of a length at once."""
    sizes = np.array([len(x) for x in series], dtype=int)
    out = np.full(len(sizes), np.nan)
    with np.errstate(all="ignore"):
        for n in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == n)
            out[at] = _rates(np.array([series[i] for i in at], dtype=float), low, high)
    return out


def solve_rate(flows: list[float], low: float = -0.999999, high: float = 10.0) -> float | None:
    found = solve_rates([flows], low, high)[0]
    return None if np.isnan(found) else float(found)


@F.pandas_udf(T.DoubleType())
def _irr(series: pd.Series) -> pd.Series:
    return pd.Series(solve_rates(series.tolist()))


def cashflow_returns(flows: DataFrame, by: str, order_by: str, amount: str) -> DataFrame:
    """Internal rate of return per series; NULL (#NUM!) where there is none.  One series is one group.

    Spark gathers each series in order as an array; a batch of arrays is solved at once."""
    x, at = F.col(amount).cast("double"), F.col(order_by)
    held = F.when(x.isNotNull() & ~F.isnan(x), F.struct(at.isNull().alias("last"), at.alias("at"), x.alias("x")))
    gathered = flows.groupBy(by).agg(F.array_sort(F.collect_list(held)).alias("_s"))
    return gathered.select(by, _irr(F.transform("_s", lambda s: s["x"])).alias("irr"))


def rate(nper: Column, payment: Column, present: Column, future: Column | float = 0.0, due: Column | int = 0, low: float = -0.999999, high: float = 10.0) -> Column:
    """Rate a period at which a loan of `present` is paid by `nper` payments; NULL (#NUM!) where none lies in low .. high.

    Bisection of a whole batch of rows at once, until no middle lies between the ends."""

    @F.pandas_udf(T.DoubleType())
    def solve(nper: pd.Series, payment: pd.Series, present: pd.Series, future: pd.Series, due: pd.Series) -> pd.Series:
        n, paid, pv, fv, at_start = (x.to_numpy(dtype=float, na_value=np.nan) for x in (nper, payment, present, future, due))

        def value(r: np.ndarray) -> np.ndarray:
            # above a rate of 0 in present money, which has the same sign and does not overflow
            grown, flat = (1 + r) ** -np.abs(n), np.abs(r) < 1e-12
            back, r1 = (1 + r) ** n, np.where(flat, 1.0, r)
            later = pv * back + paid * (1 + r * at_start) * np.where(flat, n, (back - 1) / r1) + fv
            now = pv + paid * (1 + r * at_start) * np.where(flat, n, (1 - grown) / r1) + fv * grown
            return np.sign(np.where((r > 0) & (n > 0), now, later))

        with np.errstate(all="ignore"):
            a, b = np.full(len(n), low), np.full(len(n), high)
            first = value(a)
            there = first * value(b) <= 0
            for _ in range(80):
                middle = (a + b) / 2
                same = value(middle) == first
                if not ((a < middle) & (middle < b)).any():
                    break
                a, b = np.where(same, middle, a), np.where(same, b, middle)
        return pd.Series(np.where(there, (a + b) / 2, np.nan))

    return solve(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double") for x in (nper, payment, present, future, due)])


def business_calendar(spark: SparkSession, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """(day, is_open, open_no): one row a day with the running number of business days."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS day")
    if holidays is not None:
        days = days.join(holidays.select(F.col("holiday").alias("day"), F.lit(True).alias("_off")).distinct(), "day", "left")
    else:
        days = days.withColumn("_off", F.lit(None).cast("boolean"))
    is_open = F.dayofweek("day").between(2, 6) & F.col("_off").isNull()
    # numbered within years first, so that no window spans the whole calendar
    marked = days.select("day", is_open.alias("is_open"), F.year("day").alias("_y"))
    years = marked.groupBy("_y").agg(F.count_if("is_open").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum(F.col("is_open").cast("int")).over(Window.partitionBy("_y").orderBy("day"))
    return marked.join(F.broadcast(years), "_y").select("day", "is_open", (F.col("_before") + inner).alias("open_no"))


def networkdays(df: DataFrame, start: str, end: str, calendar: DataFrame, into: str = "days") -> DataFrame:
    """Business days from start to end, both counted, negative if end comes first."""
    at = lambda c, p: calendar.select(F.col("day").alias(c), F.col("open_no").alias(f"{p}_no"), F.col("is_open").alias(f"{p}_open"))
    both = df.join(at(start, "_a"), start, "left").join(at(end, "_b"), end, "left")
    forward = F.col("_b_no") - F.col("_a_no") + F.col("_a_open").cast("int")
    back = -(F.col("_a_no") - F.col("_b_no") + F.col("_b_open").cast("int"))
    return both.withColumn(into, F.when(F.col(end) >= F.col(start), forward).otherwise(back)).select(*df.columns, into)


def workday(df: DataFrame, start: str, days: str, calendar: DataFrame, into: str = "workday") -> DataFrame:
    """The day that is so many business days after (or before) the start."""
    base = df.join(calendar.select(F.col("day").alias(start), F.col("open_no").alias("_no"), F.col("is_open").alias("_open")), start, "left")
    # going back from a closed day, the last open day before it already is one step
    target = F.when(F.col(days) < 0, F.col("_no") + F.col(days) + F.when(F.col("_open"), 0).otherwise(1)).otherwise(F.col("_no") + F.col(days))
    opened = calendar.filter("is_open").select(F.col("open_no").alias("_t"), F.col("day").alias("_day"))
    out = base.withColumn("_t", target).join(opened, "_t", "left")
    return out.withColumn(into, F.when(F.col(days) == 0, F.col(start)).otherwise(F.col("_day"))).select(*df.columns, into)

