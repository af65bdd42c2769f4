"""Queries over trees of sheets and slides, rectangles, order statistics of large groups, missing keys and planted faults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.keys import join_alike
from ..operators import aggregates as A
from ..operators import cells as K
from ..operators import charts as C
from ..operators import documents as D
from ..operators import lookups as J
from ..operators import ordered as O
from ..operators import orderstats as Q
from ..operators import rules as R
from ..streaming import history as T
from .registry import query, table
from .sheet import PART_SQL, TRAIL_SQL, part_cells
from .stored import folder

# trees ---------------------------------------------------------------------------------

#: Every brand's sheet: a region begins after each tenth row and holds three columns.
SHEET_TREE_SQL = f"""{PART_SQL}, k AS (SELECT DISTINCT sheet_id, row // 10 AS block FROM b UNION SELECT sheet_id, 0 FROM p),
r AS (SELECT sheet_id, row_number() OVER (PARTITION BY sheet_id ORDER BY block) AS region FROM k),
nodes AS (SELECT DISTINCT 'sheet/' || sheet_id AS source, 'sheet/' || sheet_id AS path, 0 AS depth, 0 AS region, 0 AS col FROM p
  UNION ALL SELECT 'sheet/' || sheet_id, 'sheet/' || sheet_id || '/region/' || region, 1, region, 0 FROM r
  UNION ALL SELECT 'sheet/' || sheet_id, 'sheet/' || sheet_id || '/region/' || region || '/column/' || chr(64 + c), 2, region, c FROM r, (VALUES (1), (2), (3)) v(c)),
placed AS (SELECT *, row_number() OVER (ORDER BY source, region, col) AS low FROM nodes)"""


def sheet_tree(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    return D.sheet_nodes(cells, cells.select("sheet_id", F.col("sheet_id").alias("name")).distinct())


@query(f"""WITH {SHEET_TREE_SQL} SELECT path, depth::INTEGER AS depth, low, low + CASE depth WHEN 2 THEN 0 WHEN 1 THEN 3 ELSE (SELECT count(*) - 1 FROM nodes n WHERE n.source = placed.source) END AS high FROM placed""")
def sheet_intervals(spark, sf_dir):
    """Places in pre-order of all sheets' regions and columns, more than nine regions included, with the last place below each."""
    return D.with_intervals(sheet_tree(spark, sf_dir)).select("path", "depth", "low", "high")


@query(f"""WITH {SHEET_TREE_SQL} SELECT source, string_agg(repeat('  ', depth) || '- ' || path || ' — ', chr(10) ORDER BY low) AS map, count(*) AS shown
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY low) AS n FROM placed) WHERE n <= 400 GROUP BY source""")
def sheet_maps(spark, sf_dir):
    """Maps of sheets by address alone, in the order of the tree, cut at the 400th node."""
    return D.map_lines(sheet_tree(spark, sf_dir).withColumn("summary", F.lit("")))


SLIDE_TREE_SQL = """e AS (SELECT user_id, event_id, event_type AS g, 'g' || event_id % 3 AS h, event_id % 4 = 0 AS bare FROM events),
f AS (SELECT *, min(CASE WHEN NOT bare THEN event_id END) OVER (PARTITION BY user_id, g) AS fg, min(CASE WHEN NOT bare THEN event_id END) OVER (PARTITION BY user_id, g, h) AS fh FROM e),
nodes AS (SELECT DISTINCT user_id, 'slide/' || user_id AS path, NULL AS parent_path, 0 AS depth, -1 AS a, -1 AS b, -1 AS c FROM e
  UNION ALL SELECT DISTINCT user_id, 'slide/' || user_id || '/group/' || g, 'slide/' || user_id, 1, fg, -1, -1 FROM f WHERE NOT bare
  UNION ALL SELECT DISTINCT user_id, 'slide/' || user_id || '/group/' || g || '/' || h, 'slide/' || user_id || '/group/' || g, 2, fg, fh, -1 FROM f WHERE NOT bare
  UNION ALL SELECT user_id, 'slide/' || user_id || '/block/' || event_id, CASE WHEN bare THEN 'slide/' || user_id ELSE 'slide/' || user_id || '/group/' || g || '/' || h END, CASE WHEN bare THEN 1 ELSE 3 END, CASE WHEN bare THEN event_id ELSE fg END, CASE WHEN bare THEN -1 ELSE fh END, CASE WHEN bare THEN -1 ELSE event_id END FROM f)"""


@query(f"""WITH {SLIDE_TREE_SQL} SELECT path, parent_path, depth::INTEGER AS depth, row_number() OVER (PARTITION BY user_id ORDER BY a, b, c)::INTEGER AS place, (SELECT count(*) FROM nodes n WHERE n.parent_path = nodes.path) AS child_count FROM nodes""")
def slide_tree(spark, sf_dir):
    """Users' events as blocks in nested groups, every fourth in none: parents, depth, children and place in the tree."""
    events = table(spark, sf_dir, "events")
    groups = F.when(F.col("event_id") % 4 > 0, F.array("event_type", F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    blocks = events.select(F.col("user_id").alias("slide_id"), F.col("event_id").alias("block_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("md"), groups.alias("group"))
    slides = events.select(F.col("user_id").alias("slide_id")).distinct().withColumn("title", F.lit("t"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("order_key"))
    return D.slide_nodes(slides, blocks).select("path", "parent_path", "depth", place.alias("place"), "child_count")


@query("""WITH t AS (SELECT conv_id, turn, role || ' ' || turn AS md, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id) AS size, (turn * 100 + 25) / 720.0 AS cy FROM conversations),
u AS (SELECT conv_id, max(size) AS size, string_agg('  - slide/' || conv_id || '/block/' || turn || ' — ' || md, chr(10) ORDER BY turn) AS map,
  string_agg('### ' || n || ') 텍스트 — ' || CASE WHEN cy < 0.28 THEN '상단 중앙' WHEN cy < 0.68 THEN '정중앙' ELSE '하단 중앙' END || ', 전체 폭' || chr(10) || chr(10) || md, chr(10) || chr(10) ORDER BY turn) AS body FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT 'slide/' || conv_id AS source, '# talk ' || conv_id || chr(10) || chr(10) || '## map' || chr(10) || '- slide/' || conv_id || ' — talk ' || conv_id || chr(10) || map || chr(10) || chr(10)
  || '## slide' || chr(10) || '- layout: plain' || chr(10) || '- blocks: ' || size || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '- notes: say it' ELSE '' END || chr(10) || chr(10) || body || chr(10) || chr(10)
  || '## statistics' || chr(10) || 'blocks ' || size || ', words ' || 2 * size || ', notes ' || (1 - conv_id % 2) AS digest FROM u""")
def slide_digests(spark, sf_dir):
    """Conversations as slides, a turn a block below the one before."""
    turns = table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    none = F.array().cast("array<string>")
    blocks = turns.select(F.col("conv_id").alias("slide_id"), F.col("turn").alias("block_id"), F.col("turn").alias("pos"), F.lit("text").alias("kind"), F.concat_ws(" ", "role", "turn").alias("md"), F.lit(0.0).alias("x"), (F.col("turn") * 100.0).alias("y"), F.lit(1280.0).alias("w"), F.lit(50.0).alias("h"), none.alias("group"))
    slides = turns.select(F.col("conv_id").alias("slide_id")).distinct().select("slide_id", F.concat(F.lit("talk "), F.col("slide_id")).alias("title"), F.lit("plain").alias("layout"), F.when(F.col("slide_id") % 2 == 0, F.lit(" say\n it ")).alias("notes"))
    return D.slide_digest(slides, blocks)


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS m, 'doc/' || c_custkey || '/b/' AS p FROM customer)
SELECT p || '1' AS path, 'warn' AS level, 'heading skips from 1 to 3' AS message FROM c WHERE m = 0
UNION ALL SELECT p || '0', 'info', 'table without a header rule' FROM c WHERE m = 1
UNION ALL SELECT p || '0', 'warn', 'empty table' FROM c WHERE m = 2
UNION ALL SELECT p || '1', 'error', 'unreadable chart' FROM c WHERE m = 3
UNION ALL SELECT p || '0', unnest(['info', 'error']), unnest(['table without a header rule', 'unreadable table']) FROM c WHERE m = 4
UNION ALL SELECT p || '3', 'warn', 'heading skips from 2 to 4' FROM c WHERE m = 5""")
def planted_findings(spark, sf_dir):
    """A text a customer, each with one fault of its own or none: all block rules in one pass."""
    texts = ["# A\n\n### B\n\ntext", "| a | b |\n| 1 | 2 |", "| a | b |\n|---|---|", 'fine\n\n```chart\n{"type": \n```', "| a |", "# A\n\n## B\n\n- x\n\n#### C", '# A\n\n## B\n\n```chart\n{"type": "pie"}\n```\n\n| a |\n|---|\n| 1 |']
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 7 + 1).cast("int")).alias("text"))
    return D.verify(D.split_blocks(docs)).select("path", "level", "message")


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN '1. ' || p_name WHEN 2 THEN 'snakecase ' || p_name WHEN 3 THEN p_name || ' x' WHEN 4 THEN p_name ELSE left(repeat(p_name || ' ', 20), 59) || '…' END AS label FROM part""")
def block_labels(spark, sf_dir):
    """Labels of blocks: headings, numbered items, marks inside words, links, bullets, long lines."""
    name, n = F.col("p_name"), F.col("p_partkey") % 6
    md = F.when(n == 0, F.concat(F.lit("first\n## *"), name, F.lit("*\nlast"))).when(n == 1, F.concat(F.lit("1. "), name)).when(n == 2, F.concat(F.lit("\n snake_case "), name))
    md = md.when(n == 3, F.concat(F.lit("["), name, F.lit("](http://a/b) ![x](y.png)"))).when(n == 4, F.concat(F.lit("- > "), name)).otherwise(F.repeat(F.concat(name, F.lit(" ")), 20))
    return table(spark, sf_dir, "part").select("p_partkey", D.block_label(md, 60).alias("label"))


@query("""WITH RECURSIVE d AS (SELECT DISTINCT user_id, event_id % 997 AS y FROM events),
t AS (SELECT user_id, min(y) AS top, 0 AS band FROM d GROUP BY user_id UNION ALL SELECT user_id, nxt, band + 1 FROM (SELECT t.user_id, t.band, (SELECT min(d.y) FROM d WHERE d.user_id = t.user_id AND d.y > t.top + 40) AS nxt FROM t) WHERE nxt IS NOT NULL),
e AS (SELECT e.user_id, e.event_id, (SELECT max(t.band) FROM t WHERE t.user_id = e.user_id AND t.top <= e.event_id % 997) AS band, e.event_id % 1280 AS x, e.event_id % 997 AS y FROM events e)
SELECT user_id, event_id, band::INTEGER AS band, row_number() OVER (PARTITION BY user_id ORDER BY band, x, y, event_id)::INTEGER - 1 AS place FROM e""")
def reading_bands(spark, sf_dir):
    """Blocks at uneven heights: a band begins where one lies more than 40 below the first of the band before."""
    n = F.col("event_id")
    blocks = table(spark, sf_dir, "events").select("user_id", "event_id", (n % 997).alias("y"), (n % 1280).alias("x"))
    return D.reading_order(blocks, "user_id", "event_id")


# rectangles ----------------------------------------------------------------------------


@query(f"""WITH {PART_SQL}, c AS (SELECT sheet_id, row, unnest([1, 2, 3]) AS col FROM b UNION ALL SELECT DISTINCT sheet_id, 1, unnest([1, 2, 3]) FROM p)
SELECT sheet_id, a.own AS row, c.row::BIGINT AS to_row, c.col::BIGINT AS to_col, a.mention::INTEGER AS mention FROM c, (VALUES (1, 1, 1, 1048576, 1, 16384, 0), (2, 2, 2, 1048576, 2, 2, 0), (3, 3, 5, 12, 1, 3, 0), (3, 3, 1, 1, 2, 2, 1)) a(k, own, r0, r1, c0, c1, mention)
WHERE c.row BETWEEN a.r0 AND a.r1 AND c.col BETWEEN a.c0 AND a.c1""")
def edges_by_tiles(spark, sf_dir):
    """Formulas of every brand's sheet that name the whole sheet, a whole column, a block and a cell: edges to cells that exist."""
    cells = part_cells(spark, sf_dir)
    formulas = ["=SUM(A1:XFD1048576)", "=MAX(B2:$B$1048576)", "=A5:C12+$B$1"]
    pairs = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("row"), F.lit(f).alias("f")) for i, f in enumerate(formulas)])).alias("x")
    asking = cells.select("project_id", "sheet_id").distinct().select("project_id", "sheet_id", pairs).select("project_id", "sheet_id", "x.row", F.lit(9).alias("col"), "x.f")
    return K.formula_edges(asking, cells).select("sheet_id", "row", F.col("to_row").cast("bigint").alias("to_row"), F.col("to_col").cast("bigint").alias("to_col"), "mention")


@query(f"""WITH {PART_SQL} SELECT sheet_id, row::BIGINT AS row, (row - (row - 2) % 3)::BIGINT AS anchor_row, (row - 2) % 3 <> 0 OR c <> 1 AS hidden, c::BIGINT AS col FROM b, (VALUES (1), (2)) v(c)
UNION ALL SELECT DISTINCT sheet_id, 1, 1, false, 3 FROM p""")
def merged_by_tiles(spark, sf_dir):
    """Cells under merges of three rows and two columns, and of a title from C1 on, given from its far end: those that exist, with their anchors."""
    cells = part_cells(spark, sf_dir)
    rows = cells.filter("row > 1").groupBy("sheet_id").agg(F.max("row").alias("last"))
    blocks = rows.select("sheet_id", F.explode(F.sequence(F.lit(2), F.col("last"), F.lit(3))).alias("r0")).select("sheet_id", "r0", F.lit(1).alias("c0"), (F.col("r0") + 2).alias("r1"), F.lit(2).alias("c1"))
    title = rows.select("sheet_id", F.lit(1).alias("r0"), F.lit(16_384).alias("c0"), F.lit(1).alias("r1"), F.lit(3).alias("c1"))
    made = J.merged_cells(blocks.unionByName(title), cells)
    return made.select("sheet_id", F.col("row").cast("bigint").alias("row"), F.col("anchor_row").cast("bigint").alias("anchor_row"), "hidden", F.col("col").cast("bigint").alias("col"))


@query("""SELECT s_nationkey AS sheet_id, n.name, s.row::BIGINT AS row, s_acctbal AS v_num FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS row FROM supplier) s, (VALUES ('all', 1, 1048576), ('third', 3, 3)) n(name, a, z) WHERE s.row BETWEEN n.a AND n.z""")
def names_of_columns(spark, sf_dir):
    """Names of a whole column and of one cell in each nation's sheet of suppliers."""
    row = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    cells = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet_id"), row.alias("row"), F.lit(1).alias("col"), F.col("s_acctbal").alias("v_num"), F.lit(None).cast("string").alias("v_str"), F.lit("n").alias("t"))
    area = lambda name, a, z: F.struct(F.lit(name).alias("name"), F.lit(a).alias("r0"), F.lit(1).alias("c0"), F.lit(z).alias("r1"), F.lit(1).alias("c1"))
    names = cells.select("sheet_id").distinct().select("sheet_id", F.inline(F.array(area("all", 1, 1_048_576), area("third", 3, 3))))
    return J.resolve_names(names, cells, blanks=False).select("sheet_id", "name", F.col("row").cast("bigint").alias("row"), "v_num")


# order statistics of large groups --------------------------------------------------------


@query("""SELECT nullif(l_returnflag, 'R') AS flag, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.001), 4) AS low, max(l_extendedprice) AS top FROM lineitem GROUP BY 1""")
def percentiles_of_large_groups(spark, sf_dir):
    """Percentiles of three groups that hold all lines, one of them without a key: no group meets in a task."""
    lines = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("flag"), "l_extendedprice")
    made = Q.quantiles(lines, "l_extendedprice", {"middle": 0.5, "p90": 0.9, "low": 0.001, "top": 1.0}, ["flag"])
    return made.select("flag", *[F.round(c, 4).alias(c) for c in ("middle", "p90", "low")], "top")


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS up, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS down FROM lineitem)
SELECT l_returnflag, max(CASE WHEN up = 1000 THEN l_extendedprice END) AS low, max(CASE WHEN down = 1000 THEN l_extendedprice END) AS high FROM r GROUP BY 1""")
def thousandth_values(spark, sf_dir):
    """Subtotal codes 14 and 15 far from the ends."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    high = Q.subtotal(lines, 14, "l_extendedprice", ["l_returnflag"], 1_000, "high")
    return high.join(Q.subtotal(lines, 115, "l_extendedprice", ["l_returnflag"], 1_000, "low"), "l_returnflag")


@query("""WITH r AS (SELECT l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_linestatus) AS n FROM lineitem)
SELECT l_linestatus, round(avg(l_quantity), 6) AS trimmean FROM r WHERE r > floor(n * 0.1 / 2) AND r <= n - floor(n * 0.1 / 2) GROUP BY 1""")
def trimmed_large_groups(spark, sf_dir):
    """Two groups of fifty distinct values: a value is weighed by how many of its places are kept."""
    return A.trimmean(table(spark, sf_dir, "lineitem"), "l_quantity", 0.1, ["l_linestatus"]).withColumn("trimmean", F.round("trimmean", 6))


@query("""SELECT l_returnflag, list_reduce(list(DISTINCT l_orderkey * 6), lambda a, b: gcd(a, b))::BIGINT AS gcd, list_reduce(list(DISTINCT (1 + l_linenumber % 5)), lambda a, b: lcm(a, b))::BIGINT AS lcm FROM lineitem GROUP BY 1""")
def divisors_of_large_groups(spark, sf_dir):
    """GCD over all order keys of a group, LCM over a few numbers that repeat, folded in parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 6).alias("k"), (1 + F.col("l_linenumber") % 5).alias("n"))
    gcd = A.gcd_lcm_of(lines, "k", ["l_returnflag"]).select("l_returnflag", "gcd")
    return gcd.join(A.gcd_lcm_of(lines, "n", ["l_returnflag"]).select("l_returnflag", "lcm"), "l_returnflag")


# missing keys and patterns ----------------------------------------------------------------


@query("""SELECT event_id, lag(event_id) OVER (PARTITION BY nullif(event_type, 'click') ORDER BY event_id) AS last FROM events""")
def nearest_of_missing_groups(spark, sf_dir):
    """The event before of the same kind, clicks having none: a missing group is one like any other."""
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"))
    asked, marks = events.withColumn("until", F.col("event_id") - 1), events.select("kind", F.col("event_id").alias("at"))
    return J.nearest(asked, "until", marks, "at", "at", "last", "below", ["kind"]).select("event_id", "last")


@query("""WITH b AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS k, c_nationkey AS n, count(*) AS v FROM customer GROUP BY 1, 2), a AS (SELECT k, n, CASE WHEN n % 5 = 0 THEN v + 1 ELSE v END AS v FROM b WHERE n <> 7)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, b.n) AS n, CASE WHEN a.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b LEFT JOIN a ON a.k IS NOT DISTINCT FROM b.k AND a.n = b.n WHERE a.n IS NULL OR a.v <> b.v""")
def changes_of_missing_keys(spark, sf_dir):
    """Rows of a key that is missing in part are compared with their like."""
    before = table(spark, sf_dir, "customer").groupBy(F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("k"), F.col("c_nationkey").alias("n")).agg(F.count("*").alias("v"))
    after = before.filter("n <> 7").withColumn("v", F.when(F.col("n") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return J.diff_rows(before, after, ["k", "n"], ["v"]).select("k", "n", "change")


@query("""WITH k AS (SELECT c_custkey, '*' || substr(c_name, 3, 12) || '*' || right(c_name, 2) AS b FROM customer)
SELECT k.c_custkey, min(p.c_custkey) AS first, count(p.c_custkey) AS fits FROM k LEFT JOIN customer p ON p.c_name ILIKE replace(k.b, '*', '%') GROUP BY 1""")
def wildcard_pieces(spark, sf_dir):
    """A pattern a customer: texts and patterns meet by a piece of three letters before any regular expression."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    asked = customers.withColumn("p", F.concat(F.lit("*"), F.substring("c_name", 3, 12), F.lit("*"), F.substring("c_name", -2, 2)))
    pairs = J.wildcard_pairs(asked, "p", customers.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("t")), "t")
    found = pairs.groupBy("_key").agg(F.min("k").alias("first"), F.count("*").alias("fits"))
    return asked.join(found, F.col("p") == F.col("_key"), "left").select("c_custkey", "first", F.coalesce("fits", F.lit(0)).alias("fits"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '#N/A' WHEN 3 THEN '#DIV/0!' WHEN 4 THEN event_type ELSE '#nope' END AS x, CASE event_id % 4 WHEN 0 THEN 'n' WHEN 1 THEN 's' WHEN 2 THEN 'b' ELSE 'e' END AS t FROM events)
SELECT event_id, x IS NULL OR x = '' AS blank, coalesce(x = '#N/A', false) AS na, coalesce(x = '#DIV/0!', false) AS err, coalesce(x IN ('#N/A', '#DIV/0!'), false) AS any_error, CASE t WHEN 's' THEN 2 WHEN 'b' THEN 4 WHEN 'e' THEN 16 ELSE 1 END AS type FROM v""")
def value_questions(spark, sf_dir):
    """ISBLANK, ISNA, ISERR, ISERROR and TYPE."""
    n = F.col("event_id") % 6
    x = F.when(n == 1, "").when(n == 2, "#N/A").when(n == 3, "#DIV/0!").when(n == 4, F.col("event_type")).when(n == 5, "#nope")
    tag = F.element_at(F.array(*[F.lit(t) for t in "nsbe"]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", E.is_blank(x).alias("blank"), E.is_na(x).alias("na"), E.is_err(x).alias("err"), E.is_error(x).alias("any_error"), E.type_number(tag).alias("type"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN NULL ELSE c_mktsegment END AS segment, c_acctbal AS x FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY c_custkey) AS i, rank() OVER (PARTITION BY segment ORDER BY x DESC) AS rank, count(*) OVER (PARTITION BY segment) AS size, avg(x) OVER (PARTITION BY segment) AS mean FROM c)
SELECT c_custkey, segment, rank::INTEGER AS rank, x > mean AS above, round((SELECT avg(abs(q.x - q.mean)) FROM r q WHERE q.segment IS NOT DISTINCT FROM r.segment), 6) AS avedev, size - 3 AS left_out FROM r WHERE i <= 3""")
def groups_without_key(spark, sf_dir):
    """Ranks, bounds, deviations and caps of groups, the largest of which has no key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") >= 12, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("x"))
    ranked = R.flag_ranked(O.rank_eq(c, "x", ["segment"]), "x", "above", by=["segment"], into="above")
    capped = O.cap_rows(ranked, ["segment"], 3, "c_custkey")
    spread = A.avedev(c, "x", ["segment"]).withColumn("avedev", F.round("avedev", 6))
    return join_alike(capped, spread, ["segment"]).select("c_custkey", "segment", "rank", "above", "avedev", "left_out")


@query("""WITH l AS (SELECT l_linestatus, l_extendedprice AS x, row_number() OVER (PARTITION BY l_linestatus ORDER BY l_orderkey * 10 + l_linenumber, l_extendedprice) AS i FROM lineitem)
SELECT l_linestatus, round(sum(x / pow(1.0001::DOUBLE, i)), 2) AS npv FROM l GROUP BY 1""")
def npv_of_large_groups(spark, sf_dir):
    """Two cash flows of tens of thousands of amounts."""
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_extendedprice").alias("x"))
    return A.npv(lines, 0.0001, "x", "at", ["l_linestatus"]).withColumn("npv", F.round("npv", 2))


@query(f"""WITH {PART_SQL} SELECT sheet_id, p_name AS label, v.name, CASE v.name WHEN 'size' THEN p_size ELSE p_retailprice END AS value FROM b, (VALUES ('size'), ('price')) v(name)""")
def series_of_whole_sheets(spark, sf_dir):
    """Charts over the whole of three columns."""
    return C.chart_data(part_cells(spark, sf_dir), "A1:C1048576").select("sheet_id", "label", "name", "value")


# history on streams -------------------------------------------------------------------------


def streamed(spark, rows, run):
    """What a stream over a folder of the given rows appends to a table."""
    path = folder(spark)
    rows.write.parquet(f"{path}/in")
    made = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")


@query("""SELECT event_id, user_id AS project, CASE WHEN event_type IN ('click', 'view') THEN 'accepted' ELSE 'conflict' END AS outcome FROM events""")
def streamed_saves(spark, sf_dir):
    """Saves as a stream with each project's version as state."""
    saves = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.when(~F.col("event_type").isin("click", "view"), F.lit("1970-01-01").cast("timestamp")).alias("base"))
    return streamed(spark, saves, T.accept_stream).select("event_id", "project", "outcome")


@query(f"WITH {TRAIL_SQL} SELECT project, event_id, content FROM trail")
def streamed_versions(spark, sf_dir):
    """Versions that a stream kept and did not drop again."""
    events = table(spark, sf_dir, "events")
    saves = events.select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.round("value", 0).cast("string").alias("content"), (F.col("event_type") == "purchase").alias("forced"))
    seen = streamed(spark, saves, T.snapshot_stream)
    return seen.groupBy("project", "event_id").agg(F.max("content").alias("content"), F.bool_or(F.col("change") == "dropped").alias("gone")).filter("NOT gone").select("project", "event_id", "content")


@query(f"""WITH {TRAIL_SQL}, n AS (SELECT project, event_id, content, row_number() OVER (PARTITION BY project ORDER BY saved_us DESC, event_id DESC) AS no FROM trail)
SELECT project, 1 AS step, 'now' AS content FROM n WHERE no = 2 UNION ALL SELECT project, 2, content FROM n WHERE no = 2""")
def restored_versions(spark, sf_dir):
    """Each project's last kept version but one, to be saved after its current state."""
    from .sheet import trail

    kept = trail(spark, sf_dir)
    current = kept.select("project").distinct().withColumn("content", F.lit("now"))
    return T.restore_all(kept, current, 2).select("project", "step", "content")


# digests, statistics and addresses of generated texts ---------------------------------------


def customer_texts(spark, sf_dir):
    """A heading and two paragraphs a customer, every third with a list."""
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("# "), F.col("c_name"), F.lit("\n\nIn "), F.lower("c_mktsegment"), F.lit(".\n\nBalance **known**.\n\n"), F.when(F.col("c_custkey") % 3 == 0, "- one\n- two\n").otherwise(""))
    return c.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("t "), F.col("c_custkey")).alias("title"), "c_nationkey", text.alias("text"))


@query("""SELECT c_nationkey, (count(*) * 3 + count_if(c_custkey % 3 = 0))::BIGINT AS blocks, (count(*) * 6 + 2 * count_if(c_custkey % 3 = 0))::BIGINT AS words, count(*) AS n_heading, count(*) * 2 AS n_paragraph, count_if(c_custkey % 3 = 0)::BIGINT AS n_list,
sum(1 + len(c_name) + 2 + len(c_mktsegment) + 1 + 17 + CASE WHEN c_custkey % 3 = 0 THEN 8 ELSE 0 END)::BIGINT AS characters FROM (SELECT * FROM customer) GROUP BY 1""")
def counted_texts(spark, sf_dir):
    """Blocks, words and characters of a text a customer, by nation."""
    docs = customer_texts(spark, sf_dir)
    stats = D.corpus_stats(D.split_blocks(docs).join(docs.select("doc_id", "c_nationkey"), "doc_id"), ["c_nationkey"])
    return stats.select("c_nationkey", "blocks", "words", "n_heading", "n_paragraph", "n_list", "characters")


@query("""WITH c AS (SELECT *, 'doc/' || c_custkey AS p, replace(lower(c_name), '#', '') AS slug, 'In ' || lower(c_mktsegment) || '.' AS says, c_custkey % 3 = 0 AS listed FROM customer)
SELECT p AS source, '# t ' || c_custkey || chr(10) || chr(10) || '## map' || chr(10) || '- ' || p || ' — t ' || c_custkey || chr(10) || '  - ' || p || '/h/' || slug || ' — ' || c_name || chr(10) || '    - ' || p || '/b/1 — ' || says || chr(10) || '    - ' || p || '/b/2 — Balance known.'
  || CASE WHEN listed THEN chr(10) || '    - ' || p || '/b/3 — one two' ELSE '' END || chr(10) || chr(10) || '## body' || chr(10) || '# ' || c_name || chr(10) || chr(10) || says || chr(10) || chr(10) || 'Balance **known**.' || CASE WHEN listed THEN chr(10) || chr(10) || '- one' || chr(10) || '- two' ELSE '' END || chr(10) || chr(10)
  || '## statistics' || chr(10) || 'blocks ' || (3 + listed::INT) || ', words ' || (6 + 2 * listed::INT) || ', characters ' || (1 + len(c_name) + 2 + len(c_mktsegment) + 1 + 17 + 8 * listed::INT) || ', headings 1' AS digest FROM c""")
def text_digests(spark, sf_dir):
    """The retrieval text of each customer's document."""
    docs = customer_texts(spark, sf_dir)
    blocks = D.split_blocks(docs)
    return D.digest(D.build_nodes(docs.select("doc_id", "title"), blocks), blocks)


@query("""SELECT conv_id AS doc_id, (2 * n + k)::INTEGER AS pos, CASE WHEN k = 0 THEN CASE WHEN r = 1 THEN role ELSE role || '-' || r END END AS block_id, CASE WHEN k = 0 THEN 'paragraph' ELSE 'list' END AS block_type, CASE WHEN k = 0 THEN 'turn ' || turn ELSE '- ' || role END AS md
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations), (VALUES (0), (1)) v(k)""")
def blocks_of_regions(spark, sf_dir):
    """Anchored regions of two blocks each: the id stays with the first."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<!-- block:"), x["role"], F.lit(" -->\nturn "), x["turn"].cast("string"), F.lit("\n\n- "), x["role"], F.lit("\n"))), "\n")
    return D.region_blocks(D.anchored_regions(turns.select("doc_id", text.alias("text")))).select("doc_id", "pos", "block_id", "block_type", "md")


@query(f"""WITH {PART_SQL} SELECT 'sheet/' || sheet_id || '/cell/B4' AS path, 'cell' AS kind, p_size::BIGINT AS shown FROM b WHERE row = 4""")
def cells_by_address(spark, sf_dir):
    """The cell B4 of every brand's sheet, asked for by its address."""
    cells = part_cells(spark, sf_dir)
    nodes = cells.select("sheet_id").distinct().select(F.concat(F.lit("sheet/"), "sheet_id", F.lit("/cell/b4")).alias("path"))
    return D.cell_nodes(cells, nodes).select("path", "kind", F.col("content").cast("double").cast("bigint").alias("shown"))


@query("""SELECT 'all.grid' AS project, sum(len(n_name) + 1)::BIGINT AS bytes FROM nation""")
def bytes_of_assets(spark, sf_dir):
    """Nations' names as files in a project's assets folder."""
    from ..sources import files as S

    path = folder(spark)
    table(spark, sf_dir, "nation").select("n_name").write.text(f"{path}/all.grid/assets/deep")
    listed = S.asset_list(spark, path).filter(F.col("asset").startswith("deep/part-"))
    return listed.groupBy("project").agg(F.sum("bytes").alias("bytes"))


@query("""SELECT v::DOUBLE AS quantity, (SELECT count(*) FROM lineitem WHERE l_quantity = v) AS lines FROM range(1, (SELECT max(l_quantity)::BIGINT + 1 FROM lineitem)) r(v)""")
def quantities_in_sequence(spark, sf_dir):
    """How often each whole quantity up to the largest occurs, those of none included."""
    from ..operators import shape as H

    lines = table(spark, sf_dir, "lineitem")
    steps = H.sequence_table(spark, int(lines.agg(F.max("l_quantity")).first()[0])).select(F.col("value").alias("quantity"))
    counts = lines.groupBy(F.col("l_quantity").cast("double").alias("quantity")).agg(F.count("*").alias("lines"))
    return steps.join(counts, "quantity", "left").select("quantity", F.coalesce("lines", F.lit(0)).alias("lines"))


@query("""WITH n AS (SELECT r_name AS s, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) + 1 AS row, count(*) OVER (PARTITION BY r_regionkey) AS size FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT 'sheet/' || s AS source, '# ' || s || chr(10) || chr(10) || '## map' || chr(10) || '- sheet/' || s || ' — ' || s || chr(10) || '  - sheet/' || s || '/region/1 — A1:A' || (max(size) + 1) || chr(10) || '    - sheet/' || s || '/region/1/column/A — text' || chr(10) || '  - sheet/' || s || '/name/all — A1:A9' || chr(10) || chr(10)
  || '## profile' || chr(10) || '- name: text, filled ' || max(size) || chr(10) || chr(10) || '## records' || chr(10) || string_agg(row || '행: name=' || replace(n_name, '_', '\\_'), chr(10) ORDER BY row) || chr(10) || chr(10)
  || '## names' || chr(10) || '- all A1:A9' || chr(10) || chr(10) || '## statistics' || chr(10) || 'cells ' || (max(size) + 1) || ', formulas 0' AS digest FROM n GROUP BY s""")
def sheet_digests(spark, sf_dir):
    """The retrieval text of a sheet a region, with the names of its nations."""
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    row = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1
    body = named.select(F.col("r_name").alias("sheet_id"), row.alias("row"), F.col("n_name").alias("v_str"))
    heads = named.select(F.col("r_name").alias("sheet_id")).distinct().select("sheet_id", F.lit(1).alias("row"), F.lit("name").alias("v_str"))
    blank = lambda kind: F.lit(None).cast(kind)
    cells = body.unionByName(heads).withColumns({"project_id": F.lit("p"), "col": F.lit(1), "ref": F.concat(F.lit("A"), "row"), "f": blank("string"), "v_num": blank("double"), "v_bool": blank("boolean"), "t": F.lit("s"), "fmt": blank("string"), "style": blank("map<string,string>")})
    sheets = heads.select("sheet_id", F.col("sheet_id").alias("name"), F.lit(0).alias("frozen_rows"))
    names = heads.select("sheet_id", F.lit("all").alias("name"), F.lit("A1:A9").alias("target"))
    return D.sheet_digest(cells, sheets, names)
