"""Queries over lookups, joins and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookups as J
from ..operators import ordered as O
from .registry import query, table

BANDS = "(VALUES (0.0, 'small'), (50000.0, 'medium'), (150000.0, 'large'), (300000.0, 'huge')) AS b(low, band)"


def bands(spark):
    return spark.sql(f"SELECT cast(low AS double) AS low, band FROM {BANDS}")


@query("""SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def vlookup_exact(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    found = J.vlookup(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey", "c_custkey")
    return J.vlookup(found, "c_nationkey", table(spark, sf_dir, "nation"), "n_nationkey", "n_name", "n_nationkey").select("o_orderkey", "n_name")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT c_custkey AS o_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""")
def vlookup_first_match(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return J.vlookup(keys, "o_custkey", table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderkey")


@query(f"""SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 'huge' WHEN o_totalprice >= 150000 THEN 'large' WHEN o_totalprice >= 50000 THEN 'medium' WHEN o_totalprice >= 0 THEN 'small' END AS band FROM orders""")
def vlookup_approximate(spark, sf_dir):
    return J.vlookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", bands(spark), "low", "band", "low", exact=False).select("o_orderkey", "band")


@query("""SELECT r_name, n AS headcount FROM region LEFT JOIN (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) USING (r_name)""")
def hlookup_regions(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    wide = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.lit("nations").alias("measure")).pivot("r_name").count()
    return J.hlookup(region.select("r_name"), "r_name", wide, "measure", "nations", "headcount")


@query("""WITH v AS (SELECT p_partkey AS pos, p_retailprice AS x FROM part), k AS (SELECT s_suppkey, 900.0 + s_suppkey * 7 AS key FROM supplier)
SELECT s_suppkey, (SELECT max(pos) FROM v WHERE x <= key) AS below, (SELECT max(pos) FROM v WHERE x >= key) AS above FROM k""")
def match_positions(spark, sf_dir):
    keys = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(900.0) + F.col("s_suppkey") * 7).alias("key"))
    vector = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("x"))
    one = J.match_position(keys, "key", vector, "x", "pos", 1, "below")
    return J.match_position(one, "key", vector, "x", "pos", -1, "above").drop("key")


@query("""WITH k AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS hit, user_id, ts AS at FROM events WHERE event_type = 'click')
SELECT k.event_id, arg_max(c.hit, c.at) AS previous FROM k LEFT JOIN c ON c.user_id = k.user_id AND c.at <= k.ts GROUP BY 1""")
def asof_previous_click(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")).cast("double"))
    keys = events.filter("event_type = 'purchase'").select("event_id", "user_id", "sec")
    clicks = events.filter("event_type = 'click'").select("user_id", "sec", F.col("event_id").alias("hit"))
    return J.nearest(keys, "sec", clicks, "sec", "hit", "previous", "below", ["user_id"]).select("event_id", "previous")


@query("""SELECT s_suppkey, coalesce((SELECT min(low) FROM (VALUES (0.0), (2500.0), (5000.0), (7500.0)) t(low) WHERE low >= s_acctbal), -1)::DOUBLE AS next_low FROM supplier""")
def xlookup_next_larger(spark, sf_dir):
    steps = spark.sql("SELECT cast(low AS double) AS low, cast(low AS double) AS next_low FROM (VALUES (0.0), (2500.0), (5000.0), (7500.0)) AS t(low)")
    return J.xlookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", steps, "low", "next_low", "low", "next_low", 1, -1.0).select("s_suppkey", "next_low")


@query("""SELECT pattern, min_by(p_partkey, p_partkey) AS first_part, max(p_partkey) AS last_part FROM (VALUES ('%#1_'), ('brand%')) t(pattern) JOIN part ON p_brand ILIKE pattern GROUP BY 1""".replace("pattern, min_by", "replace(replace(pattern, '%', '*'), '_', '?') AS pattern, min_by"))
def xlookup_wildcard(spark, sf_dir):
    keys = spark.sql("SELECT pattern FROM (VALUES ('*#1?'), ('brand*')) AS t(pattern)")
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    first = J.xlookup(keys, "pattern", part, "p_brand", "p_partkey", "p_partkey", "first_part", 2)
    lasts = part.groupBy("p_brand").agg(F.max("p_partkey").alias("p_partkey"))
    return J.xlookup(first, "pattern", lasts, "p_brand", "p_partkey", "p_partkey", "last_part", 2, last=True)


@query("""SELECT c_custkey, o_orderkey AS latest, CASE WHEN o_orderkey IS NULL THEN 'none' ELSE 'some' END AS has FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def xlookup_last_with_fallback(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    orders = table(spark, sf_dir, "orders").withColumn("word", F.lit("some"))
    out = J.xlookup(customers, "c_custkey", orders, "o_custkey", "o_orderkey", "o_orderkey", "latest", last=True)
    return J.xlookup(out, "c_custkey", orders, "o_custkey", "word", "o_orderkey", "has", if_missing="none")


@query("""WITH p AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS pos, n_nationkey FROM nation) SELECT c_custkey, pos AS matched FROM customer JOIN p ON c_nationkey = n_nationkey""")
def xmatch_positions(spark, sf_dir):
    nation = J.positions(table(spark, sf_dir, "nation").select("n_name", "n_nationkey"), ["n_name"])
    return J.xmatch(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", nation, "n_nationkey", "position").select("c_custkey", "matched")


@query("""SELECT p_partkey, CASE WHEN p_size >= 40 THEN 'XL' WHEN p_size >= 25 THEN 'L' WHEN p_size >= 10 THEN 'M' WHEN p_size >= 1 THEN 'S' END AS label FROM part""")
def lookup_vector_sizes(spark, sf_dir):
    sizes = spark.sql("SELECT * FROM (VALUES (1, 'S'), (10, 'M'), (25, 'L'), (40, 'XL')) AS t(low, label)")
    return J.lookup_vector(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", sizes, "low", "label", "label").select("p_partkey", "label")


@query("""SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def index_match_supplier(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("pos", F.col("n_nationkey") + 1)
    return J.index_match(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", nation, "n_nationkey", "n_name", "pos", "n_name").select("s_suppkey", "n_name")


CUTS = """WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0) """


def cuts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.filter("o_orderkey % 7 <> 0"), orders.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


@query(CUTS + """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice OR a.o_orderstatus <> b.o_orderstatus""")
def diff_orders(spark, sf_dir):
    return J.diff_rows(*cuts(spark, sf_dir), ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "change")


@query(CUTS + "SELECT o_orderkey, o_orderstatus FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def removed_orders(spark, sf_dir):
    return J.removed_items(*cuts(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def listed_customers(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000")
    return J.listed(table(spark, sf_dir, "customer"), "c_custkey", big, "o_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC)::INTEGER AS rank, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 10) AS percent_rank FROM orders")
def ranks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return O.percent_rank(O.rank_eq(orders, "o_totalprice", ["o_orderstatus"]), "o_totalprice", ["o_orderstatus"]).select("o_orderkey", "rank", F.round("percent_rank", 10).alias("percent_rank"))


@query("""SELECT * FROM (SELECT c_mktsegment, nth_value(c_acctbal, 3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS large3,
nth_value(c_acctbal, 3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS small3 FROM customer) GROUP BY ALL""")
def large_and_small(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal")
    large = O.nth(c, "c_acctbal", 3, ["c_mktsegment"]).withColumnRenamed("c_acctbal", "large3")
    return large.join(O.nth(c, "c_acctbal", 3, ["c_mktsegment"], False).withColumnRenamed("c_acctbal", "small3"), "c_mktsegment")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def top_orders(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def top_orders_by_customer(spark, sf_dir):
    return O.top_k(table(spark, sf_dir, "orders"), "o_totalprice", 2, "o_orderkey", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, greatest(n - 3, 0) AS left_out FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 3""")
def capped_orders(spark, sf_dir):
    return O.cap_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], 3, "o_orderkey")


@query("""SELECT min(event_id) AS event_id, lower(event_type) AS kind FROM events GROUP BY 2""")
def unique_event_types(spark, sf_dir):
    return O.unique_values(table(spark, sf_dir, "events").select("event_id", "event_type"), F.lower("event_type"), "event_id").select("event_id", F.lower("event_type").alias("kind"))


@query("""SELECT p_partkey, p_name FROM part ORDER BY p_size DESC NULLS LAST, p_name, p_partkey""")
def sorted_parts(spark, sf_dir):
    return O.sort_rows(table(spark, sf_dir, "part"), [("p_size", False), ("p_name", True)], "p_partkey").select("p_partkey", "p_name")


@query("""WITH s AS (SELECT o_orderpriority, month_no, sum(o_totalprice) AS v FROM (SELECT *, (year(o_orderdate) * 12 + month(o_orderdate))::INTEGER AS month_no FROM orders) GROUP BY 1, 2),
e AS (SELECT o_orderpriority, arg_min(v, month_no) AS first, arg_max(v, month_no) AS last, count(*) AS n FROM s GROUP BY 1)
SELECT o_orderpriority, k::INTEGER AS step_no, round(last + k * (last - first) / (n - 1), 2) AS v FROM e, range(1, 7) t(k)""")
def extended_months(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month_no")).agg(F.sum("o_totalprice").alias("v"))
    return O.extend_series(months, "v", "month_no", ["o_orderpriority"], 6).withColumn("v", F.round("v", 2))


@query("""SELECT n_name, CASE WHEN r = 1 THEN s ELSE s || '-' || r END AS anchor FROM (SELECT n_name, s, row_number() OVER (PARTITION BY s ORDER BY n_nationkey) AS r FROM (SELECT n_nationkey, n_name, lower(left(n_name, 2)) AS s FROM nation))""")
def deduped_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("s", F.lower(F.left("n_name", F.lit(2)))).withColumn("all", F.lit(1))
    return O.slug_dedupe(rows, "s", ["all"], "n_nationkey").select("n_name", "anchor")


@query("""SELECT event_id, min(n_nationkey) AS nation, min(CASE WHEN lower(left(event_type, 1)) = lower(left(n_name, 1)) THEN n_nationkey END) AS same FROM events LEFT JOIN nation ON lower(left(n_name, 1)) = lower(left(event_type, 1)) GROUP BY 1""")
def lookups_without_case(spark, sf_dir):
    """Small and capital first letters; several nations share a letter, so rows must not multiply."""
    events = table(spark, sf_dir, "events").select("event_id", F.left("event_type", F.lit(1)).alias("letter"))
    mixed = F.when(F.col("n_nationkey") % 2 == 0, F.upper(F.left("n_name", F.lit(1)))).otherwise(F.lower(F.left("n_name", F.lit(1))))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", mixed.alias("initial"))
    found = J.vlookup(events, "letter", nation, "initial", "n_nationkey", "n_nationkey", "nation")
    return J.xlookup(found, "letter", nation, "initial", "n_nationkey", "n_nationkey", "same").select("event_id", "nation", "same")


@query("""SELECT p_partkey, (SELECT max(lower(n_name)) FROM nation WHERE lower(n_name) <= lower(p_name)) AS below, (SELECT min(lower(n_name)) FROM nation WHERE lower(n_name) >= lower(p_name)) AS above FROM part""")
def nearest_texts(spark, sf_dir):
    """Approximate lookup on text keys, without case, from both sides."""
    nation = table(spark, sf_dir, "nation").select("n_name", F.lower("n_name").alias("low"))
    one = J.vlookup(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", nation, "n_name", "low", "n_name", "below", exact=False)
    return J.xlookup(one, "p_name", nation, "n_name", "low", "n_name", "above", 1).select("p_partkey", "below", "above")


@query("""SELECT o_orderkey, 9007199254740993 + o_orderkey - o_orderkey % 3 AS low FROM orders""")
def nearest_large_numbers(spark, sf_dir):
    """Whole numbers beyond 2^53, which doubles cannot tell apart."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.lit(9007199254740993) + F.col("o_orderkey")).alias("big"))
    steps = orders.select((F.col("big") - F.col("o_orderkey") % 3).alias("low")).distinct()
    return J.nearest(orders, "big", steps, "low", "low", "low").select("o_orderkey", "low")


@query("""SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY b)::INTEGER AS rank, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY b), 10) AS percent_rank FROM (SELECT *, floor(c_acctbal / 1000) AS b FROM customer)""")
def ranks_with_ties(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return O.percent_rank(O.rank_eq(customers, "b", ["c_mktsegment"], True), "b", ["c_mktsegment"]).select("c_custkey", "rank", F.round("percent_rank", 10).alias("percent_rank"))
