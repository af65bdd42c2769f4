"""Queries over the aggregate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators.rules import criteria
from .registry import query, table


@query("""SELECT l_returnflag, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F'), 0), 2) AS revenue,
count(*) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F') AS n, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F'), 4) AS average,
coalesce(max(l_extendedprice) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F'), 0) AS largest,
coalesce(min(l_extendedprice) FILTER (WHERE l_quantity > 25 AND l_linestatus = 'F'), 0) AS smallest FROM lineitem GROUP BY 1""")
def sumifs_lineitem(spark, sf_dir):
    x = F.col("l_extendedprice")
    tests = [criteria(F.col("l_quantity"), ">25"), criteria(F.col("l_linestatus"), "f")]
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.sumifs(x, *tests), 2).alias("revenue"), A.countifs(*tests).alias("n"), F.round(A.averageifs(x, *tests), 4).alias("average"), A.maxifs(x, *tests).alias("largest"), A.minifs(x, *tests).alias("smallest"))


@query("""SELECT l_shipmonth, round(coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 0), 2) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS n,
round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 4) AS average FROM (SELECT *, month(l_shipdate)::INTEGER AS l_shipmonth FROM lineitem) GROUP BY 1""")
def sumif_countif_averageif(spark, sf_dir):
    test = criteria(F.col("l_returnflag"), "=r")
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("l_shipmonth")).agg(F.round(A.sumif(x, test), 2).alias("total"), A.countif(test).alias("n"), F.round(A.averageif(x, test), 4).alias("average"))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderpriority ILIKE '%-h%' OR o_orderpriority ILIKE '_-l%') AS n FROM orders GROUP BY 1""")
def wildcard_criteria(spark, sf_dir):
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(criteria(p, "*-h*") | criteria(p, "?-L*")).alias("n"))


@query("""SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average, min(o_totalprice) AS smallest, max(o_totalprice) AS largest,
count(o_totalprice) AS numbers, count(o_orderpriority) AS filled, count(*) - count(o_orderpriority) AS blank FROM orders GROUP BY 1""")
def basic_aggregates(spark, sf_dir):
    x = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(A.total(x), 2).alias("total"), F.round(A.average(x), 4).alias("average"), A.smallest(x).alias("smallest"), A.largest(x).alias("largest"), A.count_numbers(x).alias("numbers"), A.count_filled(F.col("o_orderpriority")).alias("filled"), A.count_blank(F.col("o_orderpriority")).alias("blank"))


@query("""SELECT l_partkey, round(exp(sum(ln(1 + l_discount))), 6) AS growth, round(sum(l_tax * l_tax), 6) AS squares, round(sum(l_extendedprice * (1 - l_discount) * (l_returnflag = 'N')::INT), 4) AS net
FROM lineitem GROUP BY 1""")
def product_sumsq_sumproduct(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(A.product(1 + c("l_discount")), 6).alias("growth"), F.round(A.sum_squares(c("l_tax")), 6).alias("squares"), F.round(A.sumproduct(c("l_extendedprice"), 1 - c("l_discount"), c("l_returnflag") == "N"), 4).alias("net"))


@query("""SELECT l_suppkey, l_linestatus, round(exp(sum(ln(1 + l_discount))), 6) AS growth, round(sum(l_tax * l_tax), 6) AS squares, round(sum(l_extendedprice * (1 - l_discount) * (l_returnflag = 'N')::INT), 2) AS net
FROM lineitem GROUP BY 1, 2""")
def product_sumsq_sumproduct_all(spark, sf_dir):
    """The same over every row, by supplier, as a product over the whole table exceeds a double."""
    c = F.col
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linestatus").agg(F.round(A.product(1 + c("l_discount")), 6).alias("growth"), F.round(A.sum_squares(c("l_tax")), 6).alias("squares"), F.round(A.sumproduct(c("l_extendedprice"), 1 - c("l_discount"), c("l_returnflag") == "N"), 2).alias("net"))


@query("""SELECT l_shipmode_key, median(l_quantity) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
FROM (SELECT *, l_linenumber AS l_shipmode_key FROM lineitem) GROUP BY 1""")
def percentiles(spark, sf_dir):
    x = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("l_shipmode_key")).agg(A.median(F.col("l_quantity")).alias("median"), F.round(A.percentile(x, 0.9), 4).alias("p90"), F.round(A.quartile(x, 1), 4).alias("q1"), F.round(A.quartile(x, 3), 4).alias("q3"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 8) AS sd, round(stddev_pop(l_quantity), 8) AS sdp, round(var_samp(l_quantity), 8) AS var, round(var_pop(l_quantity), 8) AS varp,
round(var_pop(l_quantity) * count(*), 4) AS devsq, round(exp(avg(ln(l_quantity))), 8) AS geomean, round(count(*) / sum(1 / l_quantity), 8) AS harmean FROM lineitem GROUP BY 1""")
def deviations_and_means(spark, sf_dir):
    x = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp(x), 8).alias("sd"), F.round(F.stddev_pop(x), 8).alias("sdp"), F.round(F.var_samp(x), 8).alias("var"), F.round(F.var_pop(x), 8).alias("varp"), F.round(A.deviation_squares(x), 4).alias("devsq"), F.round(A.geomean(x), 8).alias("geomean"), F.round(A.harmean(x), 8).alias("harmean"))


@query("""SELECT l_returnflag, round(avg(abs(l_quantity - m)), 8) AS avedev FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""")
def average_deviation(spark, sf_dir):
    return A.avedev(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("avedev", F.round("avedev", 8))


@query("""SELECT l_returnflag, first(l_quantity ORDER BY n DESC, f) AS mode FROM (SELECT l_returnflag, l_quantity, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1""")
def mode_first_seen(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.mode(rows, "l_quantity", "seq", ["l_returnflag"])


@query("""SELECT c_mktsegment, round(avg(c_acctbal), 6) AS trimmean FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
WHERE r > floor(n * 0.2 / 2) AND r <= n - floor(n * 0.2 / 2) GROUP BY 1""")
def trimmed_mean(spark, sf_dir):
    return A.trimmean(table(spark, sf_dir, "customer"), "c_acctbal", 0.2, ["c_mktsegment"]).withColumn("trimmean", F.round("trimmean", 6))


@query("""SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 8) AS correl, round(regr_r2(l_extendedprice, l_quantity), 8) AS rsq, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope,
round(regr_intercept(l_extendedprice, l_quantity), 5) AS intercept, round(regr_intercept(l_extendedprice, l_quantity) + 30 * regr_slope(l_extendedprice, l_quantity), 4) AS forecast FROM lineitem GROUP BY 1""")
def regression(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.correl(y, x), 8).alias("correl"), F.round(A.rsq(y, x), 8).alias("rsq"), F.round(A.slope(y, x), 5).alias("slope"), F.round(A.intercept(y, x), 5).alias("intercept"), F.round(A.forecast(30, y, x), 4).alias("forecast"))


SUBTOTALS = {1: "avg(x)", 2: "count(x)", 4: "max(x)", 5: "min(x)", 7: "stddev_samp(x)", 8: "stddev_pop(x)", 9: "sum(x)", 10: "var_samp(x)", 11: "var_pop(x)", 12: "median(x)", 16: "quantile_cont(x, 0.9)", 17: "quantile_cont(x, 0.75)"}


@query(" UNION ALL ".join(f"SELECT o_orderstatus, {code} AS code, round(({sql})::DOUBLE, 3) AS value FROM (SELECT o_orderstatus, CASE WHEN o_custkey % 10 > 0 THEN o_totalprice END AS x FROM orders) GROUP BY 1" for code, sql in SUBTOTALS.items()))
def subtotal_codes(spark, sf_dir):
    bad = F.when(F.col("o_custkey") % 10 == 0, "#N/A")
    k = {16: 0.9, 17: 3}
    rows = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[F.round(A.subtotal(code, F.col("o_totalprice"), bad, k.get(code)).cast("double"), 3).alias(f"c{code}") for code in SUBTOTALS])
    return rows.select("o_orderstatus", F.inline(F.array(*[F.struct(F.lit(code).alias("code"), F.col(f"c{code}").alias("value")) for code in SUBTOTALS])))


@query("""WITH c AS (SELECT o_orderpriority, floor(o_totalprice / 5000) AS x, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY o_orderpriority) AS most FROM c),
e AS (SELECT o_orderpriority, floor(o_totalprice / 5000) AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 5000) DESC) AS down, row_number() OVER (PARTITION BY o_orderpriority ORDER BY floor(o_totalprice / 5000)) AS up FROM orders)
SELECT o_orderpriority, min(m.x) FILTER (WHERE n = most AND most > 1)::DOUBLE AS most_frequent, (SELECT x FROM e WHERE e.o_orderpriority = m.o_orderpriority AND down = 4)::DOUBLE AS fourth_largest, (SELECT x FROM e WHERE e.o_orderpriority = m.o_orderpriority AND up = 4)::DOUBLE AS fourth_smallest FROM m GROUP BY 1""")
def subtotal_of_repeats(spark, sf_dir):
    """Codes 13 to 15: the most frequent value, and the k-th largest and smallest with repeats."""
    x = F.floor(F.col("o_totalprice") / 5000).cast("double")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(A.subtotal(13, x).alias("most_frequent"), A.subtotal(14, x, None, 4).alias("fourth_largest"), A.subtotal(15, x, None, 4).alias("fourth_smallest"))


@query("""WITH s AS (SELECT DISTINCT p_brand, ((p_size % 6 + 1) * 6)::BIGINT AS v FROM part), l AS (SELECT p_brand, list(v) AS vs FROM s GROUP BY 1)
SELECT p_brand, list_reduce(list_prepend(0::BIGINT, vs), lambda a, b: greatest_common_divisor(a, b)) AS gcd, list_reduce(vs, lambda a, b: least_common_multiple(a, b)) AS lcm FROM l""")
def gcd_and_lcm(spark, sf_dir):
    gcd, lcm = A.gcd_lcm((F.col("p_size") % 6 + 1) * 6)
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(gcd.alias("gcd"), lcm.alias("lcm"))


@query("""SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1""")
def textjoin_nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(A.textjoin("n_name", "n_nationkey", "/").alias("names"))


@query("""SELECT o_custkey, round(sum(o_totalprice / power(1.05, i)), 4) AS npv FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY 1""")
def npv_by_customer(spark, sf_dir):
    return A.npv(table(spark, sf_dir, "orders"), 0.05, "o_totalprice", "o_orderkey", ["o_custkey"]).withColumn("npv", F.round("npv", 4))


PROFILED = {"l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date"}


def _profile_sql(c, kind):
    n = kind == "number"
    stat = lambda f: f"round({f}({c}::DOUBLE), 2)" if n else "NULL::DOUBLE"
    return f"SELECT '{c}' AS \"column\", '{kind}' AS type, count({c}) AS filled, count(*) - count({c}) AS blank, {stat('sum')} AS sum, {stat('avg')} AS average, {stat('min')} AS smallest, {stat('max')} AS largest FROM lineitem"


@query(" UNION ALL ".join(_profile_sql(c, k) for c, k in PROFILED.items()))
def profile_lineitem(spark, sf_dir):
    out = A.table_profile(table(spark, sf_dir, "lineitem"))
    return out.withColumns({c: F.round(c, 2) for c in ("sum", "average", "smallest", "largest")})


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS no FROM nation), s AS (SELECT year(o_orderdate)::INTEGER AS y, CASE WHEN no < 8 THEN n_name ELSE '기타' END AS series, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN r ON c_nationkey = n_nationkey)
SELECT y, series, round(sum(o_totalprice), 2) AS value FROM s GROUP BY 1, 2""")
def fold_series_nations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.year("o_orderdate").alias("y"), F.col("n_name").alias("series"), "n_nationkey", F.col("o_totalprice").alias("value"))
    return A.fold_series(rows, "series", "n_nationkey", "value", ["y"]).withColumn("value", F.round("value", 2))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1""")
def distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))

