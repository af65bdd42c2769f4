"""Further queries: references, merged and grouped blocks, anchors, findings, cycles, series from ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import aggregates as A
from ..operators import cells as K
from ..operators import charts as C
from ..operators import documents as D
from ..operators import lookups as J
from ..operators import ordered as O
from ..operators import shape as H
from ..sources import files as S
from ..streaming import history as T
from .registry import query, table
from .sheet import nation_cells, part_cells


@query("""SELECT c_custkey, n_name AS v_str, c_nationkey % 2 = 0 AS missing FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_nationkey % 2 = 1""")
def resolved_references(spark, sf_dir):
    """Each customer refers to the name cell of its nation; even nations name a sheet that is not there."""
    cells = nation_cells(spark, sf_dir)
    edges = table(spark, sf_dir, "customer").select("c_custkey", F.lit("p").alias("project_id"), F.when(F.col("c_nationkey") % 2 == 1, "NATION").otherwise("none").alias("sheet"), (F.col("c_nationkey") + 2).cast("int").alias("row"), F.lit(2).alias("col"))
    return J.resolve_refs(edges, cells).select("c_custkey", "v_str", F.col("missing_sheet").alias("missing"))


@query("""WITH b AS (SELECT user_id, event_type AS g, min(event_id) AS f, count(*) AS blocks FROM events GROUP BY 1, 2) SELECT user_id, g AS path, blocks, dense_rank() OVER (PARTITION BY user_id ORDER BY f)::INTEGER AS ordinal FROM b""")
def groups_by_appearance(spark, sf_dir):
    blocks = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"), F.array("event_type").alias("group"))
    return D.group_ordinals(blocks, "user_id").select("user_id", "path", "blocks", "ordinal")


@query("""SELECT p_brand AS sheet_id, p_name AS label, v.name, CASE v.name WHEN 'size' THEN p_size::DOUBLE ELSE p_retailprice END AS value
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part), (VALUES ('size'), ('price')) v(name) WHERE r IN (1, 2, 3, 4, 5, 6, 7, 8)""")
def series_from_ranges(spark, sf_dir):
    return C.chart_data(part_cells(spark, sf_dir), "A1:C9").select("sheet_id", "label", "name", "value")


@query("""SELECT conv_id AS doc_id, turn::INTEGER + 1 AS region, CASE WHEN r = 1 THEN role ELSE role || '-' || r END AS block_id, md5(text) AS md FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)""")
def anchored_blocks(spark, sf_dir):
    """Turns as anchored regions of one text; equal ids get a suffix."""
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = docs.select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(F.lit("<!-- block:"), x["role"], F.lit(" | n="), x["turn"].cast("string"), F.lit(" -->\n"), x["text"])), "\n").alias("text"))
    return D.anchored_regions(text).select("doc_id", F.col("region").cast("int").alias("region"), "block_id", F.md5("md").alias("md"))


@query("""SELECT 'slide/' || user_id || '/' || event_id AS path, 'off the canvas' AS message FROM events WHERE event_id % 1300 >= 1280 OR (event_id % 1300 = 0 AND event_id % 97 = 0) UNION ALL SELECT 'slide/' || user_id || '/' || event_id, 'no size' FROM events WHERE event_id % 97 = 0""")
def findings(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    boxes = events.select(F.col("user_id").alias("slide_id"), F.col("event_id").alias("block_id"), (F.col("event_id") % 1300).alias("x"), F.lit(5.0).alias("y"), F.when(F.col("event_id") % 97 == 0, 0).otherwise(20).alias("w"), F.lit(10).alias("h"))
    none = spark.createDataFrame([], "doc_id long, pos int, block_type string, md string")  # document_findings runs the rules on blocks
    return D.verify(none, boxes).select("path", "message")


@query()
def document_findings(spark, sf_dir):
    """The structure rules on the blocks of all documents."""
    return D.verify(D.split_blocks(table(spark, sf_dir, "documents"))).select("path", "level", "message")


@query("""SELECT 'p!' || lower(o_orderstatus) || '!' || (o_orderkey % 6) || '!' || c AS cell FROM (SELECT DISTINCT o_orderstatus, o_orderkey % 6 AS o_orderkey FROM orders WHERE o_orderkey % 6 IN (1, 2)), (VALUES (1), (2), (3)) v(c)""")
def cells_on_cycles(spark, sf_dir):
    """Rows 1 and 2 of each sheet hold A -> B -> C -> A; other rows a chain."""
    rows = table(spark, sf_dir, "orders").select(F.lit("p").alias("project_id"), F.col("o_orderstatus").alias("sheet_id"), (F.col("o_orderkey") % 6).cast("int").alias("row")).distinct()
    cells = rows.withColumn("col", F.explode(F.sequence(F.lit(1), F.lit(3))))
    back = F.when(F.col("row").isin(1, 2), F.concat(F.lit("=A"), F.col("row"))).otherwise(F.lit("=Z1"))
    formula = F.when(F.col("col") == 3, back).otherwise(F.concat(F.lit("="), K.column_name(F.col("col") + 1), F.col("row")))
    return K.circular_cells(K.formula_edges(cells.withColumn("f", formula)))


@query("""SELECT 'p!' || lower(o_orderstatus) || '!' || r || '!' || c AS cell FROM (SELECT DISTINCT o_orderstatus FROM orders), (VALUES (1), (2), (3)) k(r), (VALUES (1), (2), (4), (5)) v(c)
UNION ALL SELECT 'p!' || lower(o_orderstatus) || '!9!1' FROM (SELECT DISTINCT o_orderstatus FROM orders)""")
def cells_between_cycles(spark, sf_dir):
    """A <-> B -> C -> D <-> E in three rows: C lies between two cycles, on none; row 9 reads itself, rows 10 to 60 are one long chain into it."""
    sheets = table(spark, sf_dir, "orders").select(F.lit("p").alias("project_id"), F.col("o_orderstatus").alias("sheet_id")).distinct()
    pairs = [(r, a, r, b) for r in (1, 2, 3) for a, b in ((1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4))] + [(9, 1, 9, 1)] + [(r, 1, r - 1, 1) for r in range(10, 61)]
    edges = spark.createDataFrame(pairs, "row int, col int, to_row int, to_col int")
    return K.circular_cells(sheets.join(F.broadcast(edges)).withColumn("to_sheet", F.col("sheet_id")))


@query("""SELECT 'r_regionkey' AS "column", max(r_regionkey) FILTER (WHERE r_name = 'AFRICA')::VARCHAR AS africa, max(r_regionkey) FILTER (WHERE r_name = 'ASIA')::VARCHAR AS asia FROM region""")
def transposed_table(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    wide = H.transpose_table(region, "r_name", ["r_regionkey"], ["AFRICA", "ASIA"])
    return wide.select("column", F.col("AFRICA").cast("string").alias("africa"), F.col("ASIA").cast("string").alias("asia"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC)::INTEGER AS rank FROM orders")
def overall_rank(spark, sf_dir):
    return O.rank_eq(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", []).select("o_orderkey", "rank")


@query("""SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS position FROM events""")
def positions_of_events(spark, sf_dir):
    return J.positions(table(spark, sf_dir, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "position")


@query("""SELECT user_id, event_id % 3 AS kind, count(*) AS n FROM events GROUP BY ALL""")
def version_counts(spark, sf_dir):
    """Forced saves of a changing content keep every version but the last; a user has a project of each kind."""
    events = table(spark, sf_dir, "events")
    saves = events.select("event_id", (F.col("user_id") * 3 + F.col("event_id") % 3).alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.col("event_id").cast("string").alias("content"), F.lit(True).alias("forced"))
    kept = T.snapshot_trail(saves, 1_000_000).groupBy("project").agg(F.count("*").alias("n"))
    every = saves.select("project").distinct().join(kept, "project", "left")
    return every.select(F.floor(F.col("project") / 3).alias("user_id"), (F.col("project") % 3).alias("kind"), (F.coalesce("n", F.lit(0)) + 1).alias("n"))


@query("""SELECT user_id, count(*) AS n FROM events GROUP BY ALL""")
def version_counts_all(spark, sf_dir):
    """The same over the saves of every event."""
    saves = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.col("event_id").cast("string").alias("content"), F.lit(True).alias("forced"))
    kept = T.snapshot_trail(saves, 1_000_000).groupBy(F.col("project").alias("user_id")).agg(F.count("*").alias("n"))
    every = saves.select(F.col("project").alias("user_id")).distinct()
    return every.join(kept, "user_id", "left").select("user_id", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


@query("""SELECT o_orderkey, least(6, greatest(1, (o_custkey % 6) + 1)) BETWEEN 1 AND 6 AS inside FROM orders""")
def random_between(spark, sf_dir):
    dice = X.rand_between(1, 6, 7)
    return table(spark, sf_dir, "orders").select("o_orderkey", dice.between(1, 6).alias("inside"))


@query("""SELECT s_suppkey AS project_id, t.m AS md_path, t.i::INTEGER AS item_no FROM supplier, (VALUES ('b.md', 1), ('a.md', 2)) t(m, i)""")
def items_of_projects(spark, sf_dir):
    """b.md is listed, gone.md is listed but missing, a.md is there unlisted."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project_id"))
    pairs = lambda *p: F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in p]))
    listed = suppliers.select("project_id", pairs((1, "gone.md"), (2, "b.md")).alias("x")).select("project_id", F.col("x.n").alias("item_no"), F.col("x.m").alias("md_path"))
    files = suppliers.select("project_id", pairs((0, "a.md"), (0, "b.md")).alias("x")).select("project_id", F.col("x.m").alias("md_path"))
    return S.resolve_items(listed, files).select("project_id", "md_path", "item_no")


@query("""SELECT o_custkey, quantile_disc(o_totalprice, 0.5) AS middle FROM orders GROUP BY 1""")
def approximate_medians(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.percentile(F.col("o_totalprice"), 0.5, 100_000).alias("middle"))


@query("""SELECT p_brand, round(x, 2) AS chart_step FROM (SELECT p_brand, CASE WHEN raw / u <= 1 THEN 1 WHEN raw / u <= 2 THEN 2 WHEN raw / u <= 5 THEN 5 ELSE 10 END * u AS x FROM (SELECT p_brand, raw, power(10, floor(log10(raw))) AS u FROM (SELECT p_brand, sum(p_retailprice) / 5 AS raw FROM part GROUP BY 1)))""")
def axis_steps(spark, sf_dir):
    points = table(spark, sf_dir, "part").select(F.col("p_brand").alias("chart_id"), F.col("p_partkey").alias("series_no"), F.lit(0).alias("point_no"), F.col("p_retailprice").alias("value"))
    return C.axis(C.chart_measures(points)).select(F.col("chart_id").alias("p_brand"), F.round("step", 2).alias("chart_step"))

