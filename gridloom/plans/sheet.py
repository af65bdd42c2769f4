"""Queries over cells, sheets, charts, Markdown documents and history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import errors as E
from ..functions.lineage import pinned
from ..operators import cells as K
from ..operators import charts as C
from ..operators import documents as D
from ..operators import lookups as J
from ..operators import ordered as O
from ..operators import rules as R
from ..operators import shape as H
from ..sources import files as S
from ..streaming import history as T
from .registry import query, table

#: Cells of `nation` as a sheet with a header in row 1.
NATION_SQL = """n AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) + 1 AS r FROM nation),
cells AS (SELECT 1 AS row, 1 AS col, NULL::DOUBLE AS v_num, 'n_nationkey' AS v_str UNION ALL SELECT 1, 2, NULL, 'n_name' UNION ALL SELECT 1, 3, NULL, 'n_regionkey'
UNION ALL SELECT r, 1, n_nationkey, NULL FROM n UNION ALL SELECT r, 2, NULL, n_name FROM n UNION ALL SELECT r, 3, n_regionkey, NULL FROM n)"""


def nation_cells(spark, sf_dir):
    return H.to_cells(table(spark, sf_dir, "nation"), ["n_nationkey"], "nation")


def part_cells(spark, sf_dir):
    """Parts as one sheet per brand, each row at its place in the brand; every tenth row is left blank."""
    parts = table(spark, sf_dir, "part")
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1
    rows = parts.withColumn("row", place).filter("row % 10 <> 0")
    blank_n, blank_s, blank_b = F.lit(None).cast("double"), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    value = lambda i, n, s, t: F.struct(F.lit(i).alias("col"), n.alias("v_num"), s.alias("v_str"), F.lit(t).alias("t"))
    body = rows.select(F.col("p_brand").alias("sheet_id"), "row", F.explode(F.array(value(1, blank_n, F.col("p_name"), "s"), value(2, F.col("p_size").cast("double"), blank_s, "n"), value(3, F.col("p_retailprice"), blank_s, "n"))).alias("c")).select("sheet_id", "row", "c.*")
    heads = parts.select(F.col("p_brand").alias("sheet_id")).distinct().select("sheet_id", F.lit(1).alias("row"), F.explode(F.array(*[value(i + 1, blank_n, F.lit(n), "s") for i, n in enumerate(("name", "size", "price"))])).alias("c")).select("sheet_id", "row", "c.*")
    every = body.unionByName(heads)
    return every.select(F.lit("parts").alias("project_id"), "sheet_id", "row", "col", F.concat(K.column_name(F.col("col")), F.col("row").cast("string")).alias("ref"), blank_s.alias("f"), "v_num", "v_str", blank_b.alias("v_bool"), "t", blank_s.alias("fmt"), F.lit(None).cast("map<string,string>").alias("style"))


def no_frozen(cells):
    return cells.select("sheet_id").distinct().withColumn("frozen_rows", F.lit(0))


PART_SQL = """p AS (SELECT p_brand AS sheet_id, p_name, p_size::DOUBLE AS p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row FROM part), b AS (SELECT * FROM p WHERE row % 10 <> 0)"""


@query(f"WITH {NATION_SQL} SELECT row::INTEGER AS row, col, v_num, v_str, chr(64 + col) || row AS ref FROM cells")
def cells_of_nation(spark, sf_dir):
    return nation_cells(spark, sf_dir).select("row", "col", "v_num", "v_str", "ref")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) + 1)::INTEGER AS row, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def table_of_cells(spark, sf_dir):
    return H.to_table(nation_cells(spark, sf_dir), ["key", "name", "region"]).select("row", "key", "name")


@query(f"WITH {NATION_SQL} SELECT col AS row, row::INTEGER AS col, v_str FROM cells WHERE v_str IS NOT NULL")
def transposed_cells(spark, sf_dir):
    return H.transpose_cells(nation_cells(spark, sf_dir)).filter("v_str IS NOT NULL").select("row", "col", "v_str")


@query(f"WITH {NATION_SQL} SELECT row::INTEGER AS row, col, coalesce(v_str, v_num::BIGINT::VARCHAR) AS value FROM cells WHERE lower(coalesce(v_str, v_num::BIGINT::VARCHAR)) LIKE '%1%'")
def found_cells(spark, sf_dir):
    return R.find_cells(nation_cells(spark, sf_dir), "1").select("row", "col", K.shown().alias("value"))


@query(f"WITH {NATION_SQL} SELECT row::INTEGER AS row, col, CASE WHEN v_str IS NOT NULL THEN regexp_replace(v_str, 'i', '1', 'gi') END AS v_str FROM cells")
def replaced_cells(spark, sf_dir):
    return R.replace_cells(nation_cells(spark, sf_dir), "i", "1").filter("col > 0").select("row", "col", "v_str")


@query(f"WITH {NATION_SQL} SELECT count(*) AS filled, count(v_num) AS numbers, sum(v_num) AS total, avg(v_num) AS average FROM cells WHERE row BETWEEN 2 AND 11 AND col BETWEEN 1 AND 3")
def selection_of_nation(spark, sf_dir):
    return K.selection_stats(nation_cells(spark, sf_dir), "A2:C11").select("filled", "numbers", "total", "average")


@query(f"WITH {NATION_SQL} SELECT (row - 2)::INTEGER AS r, col - 1 AS c, v_str FROM cells WHERE row BETWEEN 3 AND 7 AND col BETWEEN 2 AND 3")
def sliced_cells(spark, sf_dir):
    return K.slice_range(nation_cells(spark, sf_dir), "A1", 2, 1, 5, 2).select("r", "c", "v_str")


@query(f"WITH {PART_SQL}, e AS (SELECT sheet_id, max(row) AS m FROM b GROUP BY 1) SELECT sheet_id, 1 AS r0, 1 AS c0, m::INTEGER AS r1, 3 AS c1 FROM e")
def used_ranges(spark, sf_dir):
    return K.used_range(part_cells(spark, sf_dir)).select("sheet_id", "r0", "c0", "r1", "c1")


@query(f"WITH {PART_SQL}, x AS (SELECT sheet_id, row FROM b UNION SELECT DISTINCT sheet_id, 1 FROM p), i AS (SELECT sheet_id, row, row - row_number() OVER (PARTITION BY sheet_id ORDER BY row) AS k FROM x) SELECT sheet_id, 'A' || min(row) || ':C' || max(row) AS address FROM i GROUP BY sheet_id, k")
def regions_of_parts(spark, sf_dir):
    return K.find_regions(part_cells(spark, sf_dir)).select("sheet_id", "address")


@query(f"""WITH {PART_SQL}, h AS MATERIALIZED (SELECT * FROM b WHERE row IN (2, 3, 4, 5, 6, 7, 8, 9)) SELECT sheet_id, 2 AS col, 'size' AS header, 'number' AS type, count(*) AS numbers, sum(p_size) AS total, round(avg(p_size), 6) AS average, min(p_size) AS smallest, max(p_size) AS largest FROM h GROUP BY 1
UNION ALL SELECT sheet_id, 3, 'price', 'number', count(*), round(sum(p_retailprice), 6), round(avg(p_retailprice), 6), min(p_retailprice), max(p_retailprice) FROM h GROUP BY 1
UNION ALL SELECT sheet_id, 1, 'name', 'text', 0, NULL, NULL, NULL, NULL FROM h GROUP BY 1""")
def profiled_columns(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    out = K.column_profile(cells, no_frozen(cells))
    return out.select("sheet_id", "col", "header", "type", "numbers", F.round("total", 6).alias("total"), F.round("average", 6).alias("average"), "smallest", "largest")


@query(f"""WITH {PART_SQL}, x AS (SELECT sheet_id, row, p_size FROM b UNION ALL SELECT DISTINCT sheet_id, 1, NULL FROM p), i AS (SELECT *, row - row_number() OVER (PARTITION BY sheet_id ORDER BY row) AS k FROM x),
g AS (SELECT sheet_id, dense_rank() OVER (PARTITION BY sheet_id ORDER BY k) AS region, row, min(row) OVER (PARTITION BY sheet_id, k) AS r0, p_size FROM i)
SELECT sheet_id, region::INTEGER AS region, c.col, CASE WHEN count(p_size) FILTER (WHERE row > r0) = 0 THEN 'empty' WHEN c.col = 1 THEN 'text' ELSE 'number' END AS type, count(p_size) FILTER (WHERE row > r0) AS filled,
CASE c.col WHEN 2 THEN sum(p_size) FILTER (WHERE row > r0) WHEN 3 THEN round(sum(p_retailprice) FILTER (WHERE row > r0), 4) END AS total FROM g, (VALUES (1), (2), (3)) c(col) GROUP BY 1, 2, 3""".replace("p_size FROM b UNION ALL SELECT DISTINCT sheet_id, 1, NULL FROM p)", "p_size, p_retailprice FROM b UNION ALL SELECT DISTINCT sheet_id, 1, NULL, NULL FROM p)").replace("AS r0, p_size FROM i)", "AS r0, p_size, p_retailprice FROM i)"))
def profiled_regions(spark, sf_dir):
    out = K.region_profile(part_cells(spark, sf_dir))
    return out.select("sheet_id", "region", "col", "type", F.coalesce("filled", F.lit(0)).alias("filled"), F.round("total", 4).alias("total"))


@query(f"""WITH {PART_SQL} SELECT sheet_id, 1 AS header_row, 2 AS first_row, least(9, max(row))::INTEGER AS last_row, 0::BIGINT AS left_out, max(row) > 9 AS cut_off FROM b GROUP BY 1""")
def summary_scopes(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    return K.summary_scope(cells, no_frozen(cells)).select("sheet_id", "header_row", "first_row", "last_row", "left_out", "cut_off")


@query(f"""WITH {PART_SQL} SELECT DISTINCT sheet_id, false AS is_header FROM p UNION ALL SELECT DISTINCT sheet_id || '#', true FROM p""")
def header_guess(spark, sf_dir):
    """Each sheet as it is (a column of texts under a text), and again without that column."""
    cells = part_cells(spark, sf_dir)
    numbers = cells.filter("col > 1").withColumn("sheet_id", F.concat("sheet_id", F.lit("#")))
    return K.looks_like_header(cells.unionByName(numbers)).select("sheet_id", "is_header")


@query(f"""WITH {PART_SQL} SELECT sheet_id, row::INTEGER AS row, row || '행: name=' || regexp_replace(p_name, '([*_`])', '\\\\\\1', 'g') || ', size=' || p_size::BIGINT || ', price=' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END AS record FROM b""")
def row_records(spark, sf_dir):
    cells = part_cells(spark, sf_dir)
    return K.records(cells, no_frozen(cells)).select("sheet_id", "row", "record")


@query("""SELECT o_orderpriority AS a, n, 'st' || row_number() OVER (ORDER BY n DESC, o_orderpriority) AS style_id FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)""")
def shared_styles(spark, sf_dir):
    """Style dictionary of a sheet whose cells carry one style per order priority, by use."""
    orders = table(spark, sf_dir, "orders")
    cells = orders.select(F.lit("p").alias("project_id"), F.lit("s").alias("sheet_id"), "o_orderkey", F.create_map(F.lit("a"), F.col("o_orderpriority")).alias("style"))
    coded, known = K.encode_styles(cells)
    ids = coded.groupBy("style_id").agg(F.count("*").alias("coded"))
    back = K.decode_styles(coded, known).groupBy(F.col("style")["a"].alias("a")).agg(F.count("*").alias("n"))
    named = known.select("style_id", F.col("style")["a"].alias("a")).join(ids, "style_id")
    return back.join(named, "a").filter("n = coded").select("a", "n", "style_id")


FORMULAS = "(SELECT p_brand AS sheet, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS r FROM part)"


def formula_cells(spark, sf_dir):
    """Column D of each brand's sheet: a product of B and C of the same row, the 8th row a sum of those above."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + 1
    rows = table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), F.col("p_brand").alias("sheet_id"), place.alias("row"), F.lit(4).alias("col"))
    formula = F.when(F.col("row") == 8, F.lit('=SUM(D2:D7)&" D9"')).otherwise(F.concat(F.lit("=B"), F.col("row"), F.lit("*$C$1+ROUND(C"), F.col("row"), F.lit(",2)")))
    return rows.withColumn("f", formula).withColumn("v_num", F.lit(None).cast("double")).withColumn("v_str", F.lit(None).cast("string")).withColumn("v_bool", F.lit(None).cast("boolean"))


@query(f"""SELECT sheet AS sheet_id, r::INTEGER AS row, t.c AS to_ref FROM {FORMULAS}, unnest(CASE WHEN r = 8 THEN ['D2', 'D3', 'D4', 'D5', 'D6', 'D7'] ELSE ['B' || r, 'C1', 'C' || r] END) t(c)""")
def formula_references(spark, sf_dir):
    edges = K.formula_edges(formula_cells(spark, sf_dir))
    return edges.select("sheet_id", "row", F.concat(K.column_name(F.col("to_col")), F.col("to_row").cast("string")).alias("to_ref"))


@query(f"""SELECT sheet AS sheet_id, CASE WHEN r = 8 THEN 'SUM' ELSE 'ROUND' END AS name, count(*) AS calls FROM {FORMULAS} GROUP BY 1, 2""")
def functions_used(spark, sf_dir):
    return K.function_usage(formula_cells(spark, sf_dir)).select("sheet_id", "name", "calls")


@query(f"""SELECT sheet AS sheet_id, min(r)::INTEGER AS first_row, max(r)::INTEGER AS last_row, count(*) AS n FROM {FORMULAS} WHERE r <> 8 GROUP BY 1, r > 8 HAVING count(*) >= 4""")
def runs_of_formulas(spark, sf_dir):
    return K.formula_runs(formula_cells(spark, sf_dir)).select("sheet_id", "first_row", "last_row", "n")


@query(f"""SELECT sheet AS sheet_id, r::INTEGER AS row FROM {FORMULAS} WHERE r = 8""")
def rows_of_totals(spark, sf_dir):
    return K.total_rows(formula_cells(spark, sf_dir)).select("sheet_id", "row")


@query("""SELECT n_nationkey, n_name FROM nation JOIN (SELECT min(n_regionkey) AS lo FROM nation) ON n_regionkey = lo""")
def named_ranges(spark, sf_dir):
    """The value of each cell of the named range B2:B26 that stands in a row of region 0."""
    cells = nation_cells(spark, sf_dir)
    names = spark.createDataFrame([("nation", "names", 2, 2, 26, 2)], "sheet_id string, name string, r0 int, c0 int, r1 int, c1 int")
    found = J.resolve_names(names, cells).select("row", F.col("v_str").alias("n_name"))
    keys = H.to_table(cells, ["n_nationkey", "n_name", "n_regionkey"]).filter("n_regionkey = '0'").select("row", F.col("n_nationkey").cast("int").alias("n_nationkey"))
    return found.join(keys, "row").select("n_nationkey", "n_name")


@query("""SELECT n_nationkey, t.k AS row, n_nationkey % 3 + 1 AS col FROM nation, unnest([1, 2, 3]) t(k)""".replace("n_nationkey % 3 + 1 AS col", "c.k AS col").replace("t(k)", "t(k), unnest([1, 2]) c(k)"))
def covered_by_merges(spark, sf_dir):
    merges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sheet_id"), F.lit(1).alias("r0"), F.lit(1).alias("c0"), F.lit(3).alias("r1"), F.lit(2).alias("c1"))
    return J.merge_cover(merges).select(F.col("sheet_id").alias("n_nationkey"), "row", "col")


@query("""SELECT c_custkey % 4 AS x, c_nationkey AS y, count(*) AS n FROM customer GROUP BY ALL""")
def unioned_sheets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    sheets = [c.filter(F.col("c_custkey") % 4 == k).select(F.lit(k).cast("bigint").alias("x"), F.col("c_nationkey").alias("y"), *([F.lit(1).alias("extra")] if k else [])) for k in range(4)]
    return H.union_sheets(sheets).groupBy("x", "y").agg(F.count("*").alias("n"))


CHARTS = """c AS (SELECT c_mktsegment AS chart_id, year(o_orderdate)::INTEGER AS y, o_orderstatus AS name, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def segment_charts(spark, sf_dir):
    """One chart a market segment: years as labels, a series per order status."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = rows.groupBy(F.col("c_mktsegment").alias("chart_id"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    years = sorted(r["y"] for r in sums.select("y").distinct().collect())  # a row a year
    wide = sums.groupBy("chart_id", "name").pivot("y", years).agg(F.first("value"))
    series = wide.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("name", F.array(*[F.col(str(y)) for y in years]).alias("values")))).alias("series"))
    return series.select("chart_id", F.lit("column").alias("type"), F.col("chart_id").alias("title"), F.array(*[F.lit(str(y)) for y in years]).alias("labels"), "series", F.lit(None).cast("string").alias("range"), F.lit("columns").alias("orientation"))


@query(f"""WITH {CHARTS} SELECT chart_id, y::VARCHAR AS label, max(value) FILTER (WHERE name = 'F') AS "F", max(value) FILTER (WHERE name = 'O') AS "O", max(value) FILTER (WHERE name = 'P') AS "P" FROM c GROUP BY 1, 2""")
def charts_as_tables(spark, sf_dir):
    return C.chart_table(segment_charts(spark, sf_dir), ["F", "O", "P"]).select("chart_id", "label", "F", "O", "P")


@query(f"""WITH {CHARTS}, f AS (SELECT * FROM c WHERE value IS NOT NULL) SELECT chart_id, y::VARCHAR AS label, name, round(CASE WHEN name = min(name) OVER (PARTITION BY chart_id) THEN value / sum(value) FILTER (WHERE name = 'F') OVER (PARTITION BY chart_id) END, 8) AS share,
round(sum(value) OVER (PARTITION BY chart_id, y ORDER BY name), 2) AS "end" FROM f""")
def chart_shares_and_stacks(spark, sf_dir):
    out = C.chart_measures(C.chart_points(segment_charts(spark, sf_dir))).filter("value IS NOT NULL")
    return out.select("chart_id", "label", "name", F.round("share", 8).alias("share"), F.round("end", 2).alias("end"))


@query("""SELECT c_mktsegment AS chart_id, 'column "' || c_mktsegment || '", series: F, O, P, ' || (SELECT count(DISTINCT year(o_orderdate)) FROM orders) || ' points' AS description FROM customer GROUP BY c_mktsegment""")
def chart_descriptions(spark, sf_dir):
    return C.describe_charts(segment_charts(spark, sf_dir))


PLAIN_SQL = "coalesce(text, '')"
for _pattern, _new in D.PLAIN_REWRITES:
    PLAIN_SQL = f"regexp_replace({PLAIN_SQL}, '{_pattern}', '{_new.replace('$1', chr(92) + '1')}', 'g')"


@query(f"""SELECT doc_id, md5({PLAIN_SQL}) AS plain_md5 FROM documents""")
def plain_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(D.plain_text(F.col("text"))).alias("plain_md5"))


@query(f"""SELECT doc_id, len(regexp_extract_all(t, '[ᄀ-ᇿ　-ヿ㄰-㆏一-鿿가-힣]')) + len(regexp_extract_all(t, '[A-Za-z0-9''’-]+')) AS words FROM (SELECT doc_id, {PLAIN_SQL} AS t FROM documents)""")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.count_words(F.col("text")).cast("bigint").alias("words"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
k AS (SELECT *, regexp_matches(line, '^[ \\t\\r]*$') AS blank, regexp_matches(line, '^(#{1,6}[ \\t]+\\S|[ \\t]*([-*+]|[0-9]{1,9}[.)])[ \\t]+|[ \\t]*\\||[ \\t]{0,3}>|[ \\t]{0,3}(```|~~~)|[ \\t]{0,3}([-*_][ \\t]*){3,}$)') AS marked FROM l),
d AS (SELECT doc_id, bool_or(marked) AS any_marked FROM k GROUP BY 1), r AS (SELECT doc_id, blank, lag(blank, 1, true) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k)
SELECT r.doc_id, count(*) FILTER (WHERE NOT blank AND before) AS blocks FROM r JOIN d USING (doc_id) WHERE NOT any_marked GROUP BY 1""")
def paragraph_blocks(spark, sf_dir):
    """Number of blocks of the documents that hold paragraphs only."""
    blocks = D.split_blocks(table(spark, sf_dir, "documents"))
    counted = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.bool_and(F.col("block_type").isin("paragraph", "image")).alias("plain"))
    marked = r"(?m)^(#{1,6}[ \t]+\S|[ \t]*([-*+]|[0-9]{1,9}[.)])[ \t]+|[ \t]*\||[ \t]{0,3}>|[ \t]{0,3}(```|~~~)|[ \t]{0,3}([-*_][ \t]*){3,}$)"
    plain = table(spark, sf_dir, "documents").filter(~F.col("text").rlike(marked)).select("doc_id")
    return plain.join(counted, "doc_id", "left").select("doc_id", F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query()
def corpus_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.corpus_stats(D.split_blocks(docs).join(docs.select("doc_id", "source"), "doc_id"), ["source"])


def titled(spark, sf_dir):
    """Documents with the first line as a heading, so that there is an outline to find."""
    docs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    level = lambda x: F.when(x["turn"] == 0, "# ").when(x["role"] == "user", "## ").otherwise("#### ")
    return docs.select("doc_id", F.array_join(F.transform("t", lambda x: F.concat(level(x), x["role"], F.lit("\n\n"), F.regexp_replace(x["text"], "(?m)^", "> "))), "\n\n").alias("text"))


@query("""SELECT conv_id AS doc_id, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 4 END AS level, role AS title, CASE WHEN r = 1 THEN role ELSE role || '-' || r END AS anchor
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations)""")
def outlines(spark, sf_dir):
    return D.outline(D.split_blocks(titled(spark, sf_dir))).select("doc_id", "level", "title", "anchor")


@query("""SELECT conv_id AS doc_id, count(*) AS skips FROM (SELECT *, lag(lv) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT *, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 4 END AS lv FROM conversations)) WHERE lv > p + 1 GROUP BY 1""")
def skipped_levels(spark, sf_dir):
    return D.level_skips(D.split_blocks(titled(spark, sf_dir))).groupBy("doc_id").agg(F.count("*").alias("skips"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 4 END AS lv FROM conversations)
SELECT a.conv_id AS doc_id, a.turn, (SELECT max(b.turn) FROM l b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.lv < a.lv) AS parent_turn FROM l a""")
def parents_of_headings(spark, sf_dir):
    placed = D.heading_parents(D.split_blocks(titled(spark, sf_dir)))
    heads = placed.filter("level > 0").withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1)
    names = heads.select("doc_id", F.col("pos").alias("parent_pos"), F.col("turn").alias("parent_turn"))
    return heads.join(names, ["doc_id", "parent_pos"], "left").select("doc_id", F.col("turn").cast("bigint").alias("turn"), F.col("parent_turn").cast("bigint").alias("parent_turn"))


def tree(spark, sf_dir):
    docs = titled(spark, sf_dir)
    blocks = pinned(D.split_blocks(docs))  # the texts are cut once
    return D.build_nodes(docs.select("doc_id", F.concat(F.lit("conversation "), F.col("doc_id")).alias("title")), blocks), blocks


@query("""SELECT 'doc/' || conv_id AS source, (1 + 2 * count(*))::BIGINT AS nodes FROM conversations GROUP BY conv_id""")
def node_counts(spark, sf_dir):
    return tree(spark, sf_dir)[0].groupBy("source").agg(F.count("*").alias("nodes"))


TREE_SQL = """t AS (SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 4 END AS level, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, max(CASE WHEN turn > 0 AND role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations),
h AS (SELECT *, 'doc/' || conv_id || '/h/' || CASE WHEN r = 1 THEN role ELSE role || '-' || r END AS path, CASE WHEN level = 1 THEN NULL WHEN level = 4 AND asked IS NOT NULL THEN asked ELSE 0 END AS up, CASE WHEN level = 1 THEN 1 WHEN level = 4 AND asked IS NOT NULL THEN 3 ELSE 2 END AS depth FROM t),
nodes AS (SELECT conv_id, 'doc/' || conv_id AS path, NULL AS parent_path, 0 AS depth, 'document' AS kind FROM conversations GROUP BY conv_id
  UNION ALL SELECT h.conv_id, h.path, coalesce(p.path, 'doc/' || h.conv_id), h.depth, 'heading' FROM h LEFT JOIN h p ON p.conv_id = h.conv_id AND p.turn = h.up
  UNION ALL SELECT conv_id, 'doc/' || conv_id || '/b/' || (2 * i + 1), path, depth + 1, 'quote' FROM h),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.parent_path = n.path) AS child_count FROM nodes n)"""


@query(f"WITH {TREE_SQL} SELECT path, parent_path, depth::INTEGER AS depth, kind, child_count FROM counted")
def node_tree(spark, sf_dir):
    """The addressed tree of every conversation: parents, true depth and children."""
    return tree(spark, sf_dir)[0].select("path", "parent_path", "depth", "kind", "child_count")


@query(f"WITH {TREE_SQL} SELECT path, kind, depth::INTEGER AS depth, child_count, true AS found FROM counted WHERE conv_id = 1 AND depth <= 3 UNION ALL SELECT 'doc/none', NULL, NULL, NULL, false")
def resolved_address(spark, sf_dir):
    """One conversation's address with all below it, and an address that is not there."""
    nodes = pinned(tree(spark, sf_dir)[0])  # written once, then asked by address
    found = D.resolve(nodes, "doc/1", 3).unionByName(D.resolve(nodes, "doc/none", 3))
    return found.select("path", "kind", "depth", "child_count", "found")


@query()
def maps_and_digests(spark, sf_dir):
    nodes, blocks = tree(spark, sf_dir)
    return D.digest(nodes, blocks, D.verify(blocks))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (SELECT page_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(lower(url), '[/\\\\?%*:|"<>.]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+', ''), 60), '-+$', '') AS s FROM pages)""")
def slugs_of_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.slugify(F.col("url"), F.lit("untitled")).alias("slug"))


@query("""WITH b AS (SELECT event_id, event_id % 1280 AS x, event_id % 720 AS y, event_id % 1291 AS w FROM events), c AS (SELECT *, (x + w / 2.0) / 1280 AS cx, (y + 25) / 720.0 AS cy, floor(w / 1280.0 * 100 + 0.5)::INTEGER AS share FROM b),
p AS (SELECT *, CASE WHEN cy < 0.28 THEN '상단' WHEN cy < 0.68 THEN '중앙' ELSE '하단' END AS v, CASE WHEN cx < 0.3 THEN '좌측' WHEN cx < 0.7 THEN '중앙' ELSE '우측' END AS h FROM c)
SELECT event_id, CASE WHEN v = '중앙' AND h = '중앙' THEN '정중앙' ELSE v || ' ' || h END || ', ' || CASE WHEN share >= 85 THEN '전체 폭' WHEN share <= 35 THEN '좁은 폭' ELSE '폭 ' || share || '%' END AS phrase FROM p""")
def positions_in_words(spark, sf_dir):
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", D.position_phrase(n % 1280, n % 720, n % 1291, F.lit(50)).alias("phrase"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10, event_id)::INTEGER - 1 AS place FROM events""")
def reading_orders(spark, sf_dir):
    """Blocks in bands 100 apart read by band, then by x."""
    blocks = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 10) * 100.0).alias("y"), F.col("event_id").cast("double").alias("x"))
    return D.reading_order(blocks, "user_id", "event_id").select("user_id", "event_id", "place")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 10, event_id)::INTEGER - 1 AS place FROM events""")
def reading_orders_all(spark, sf_dir):
    """The same for the blocks of every user."""
    blocks = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") % 10) * 100.0).alias("y"), F.col("event_id").cast("double").alias("x"))
    return D.reading_order(blocks, "user_id", "event_id").select("user_id", "event_id", "place")


@query("""SELECT event_id, user_id AS project, CASE WHEN event_type IN ('click', 'view') THEN 'accepted' ELSE 'conflict' END AS outcome FROM events""")
def accepted_saves(spark, sf_dir):
    """Clicks and views save without a base, the rest with one that never was a version."""
    events = table(spark, sf_dir, "events")
    saves = events.select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.when(~F.col("event_type").isin("click", "view"), F.lit("1970-01-01").cast("timestamp")).alias("base"))
    return T.accept_saves(saves).select("event_id", "project", "outcome")


TRAIL_SQL = """RECURSIVE s AS (SELECT user_id AS project, event_id, epoch_us(ts) AS us, round(value, 0)::VARCHAR AS content, event_type = 'purchase' AS forced, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT project, i, event_id, us, content, NULL::BIGINT AS k_id, NULL::BIGINT AS k_at, NULL::VARCHAR AS k_text, false AS made FROM s WHERE i = 1
  UNION ALL SELECT project, i, event_id, us, content, CASE WHEN keep THEN o_id ELSE k_id END, CASE WHEN keep THEN o_at ELSE k_at END, CASE WHEN keep THEN o_text ELSE k_text END, keep FROM (
    SELECT s.*, f.event_id AS o_id, f.us AS o_at, f.content AS o_text, f.k_id, f.k_at, f.k_text, f.k_id IS NULL OR (f.content <> f.k_text AND (s.forced OR s.us - f.k_at >= 120000000)) AS keep FROM f JOIN s ON s.project = f.project AND s.i = f.i + 1)),
trail AS (SELECT project, k_id AS event_id, k_at AS saved_us, k_text AS content FROM f WHERE made QUALIFY row_number() OVER (PARTITION BY project ORDER BY k_at DESC, k_id DESC) <= 30)"""


def trail(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    saves = events.select("event_id", F.col("user_id").alias("project"), F.col("ts").cast("timestamp").alias("saved_at"), F.round("value", 0).cast("string").alias("content"), (F.col("event_type") == "purchase").alias("forced"))
    return T.snapshot_trail(saves)


@query(f"WITH {TRAIL_SQL} SELECT project, event_id, saved_us, content, row_number() OVER (PARTITION BY project ORDER BY saved_us DESC, event_id DESC)::INTEGER AS version_no FROM trail")
def kept_versions(spark, sf_dir):
    return trail(spark, sf_dir).select("project", "event_id", F.unix_micros("saved_at").alias("saved_us"), "content", "version_no")


@query(f"WITH {TRAIL_SQL}, m AS (SELECT median(epoch_us(ts))::BIGINT // 1000000 AS middle FROM events) SELECT project, arg_max(event_id, (saved_us, event_id)) AS event_id, arg_max(content, (saved_us, event_id)) AS content FROM trail, m WHERE saved_us <= middle * 1000000 GROUP BY project")
def versions_at_the_middle(spark, sf_dir):
    """What each project's newest kept version was at the median of all saves."""
    middle = table(spark, sf_dir, "events").agg(F.floor(F.median(F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000)).first()[0]
    at = spark.range(1).select(F.timestamp_seconds(F.lit(int(middle))).cast("string").alias("t")).first()["t"]
    return T.versions_at(trail(spark, sf_dir), at).select("project", "event_id", "content")


@query("""SELECT doc_id, count(*) AS rows, max(len(string_split(line, '|')) - 2) AS width FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM (SELECT s_suppkey AS doc_id, '| a | b | c |' || chr(10) || '|---|---|---|' || chr(10) || repeat('| 1 | 2 | 3 |' || chr(10), (1 + s_suppkey % 5)::INTEGER) AS text FROM supplier)) WHERE line LIKE '|%' AND line NOT LIKE '|---%' GROUP BY 1""")
def markdown_tables(spark, sf_dir):
    """Each supplier's document holds one table with some rows."""
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("| a | b | c |\n|---|---|---|\n"), F.repeat(F.lit("| 1 | 2 | 3 |\n"), (1 + F.col("s_suppkey") % 5).cast("int"))).alias("text"))
    return S.extract_md_tables(docs).groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.size("values")).cast("bigint").alias("width"))


@query("""SELECT s_suppkey AS doc_id, 'column' AS type, s_acctbal AS first, 2 AS n FROM supplier""")
def charts_in_markdown(spark, sf_dir):
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit('text\n```chart\n{"type": "unknown", "categories": ["a", "b"], "series": [{"name": "s", "values": ['), F.col("s_acctbal").cast("string"), F.lit(', "x"]}]}\n```\n')).alias("text"))
    return S.extract_charts(docs).select("doc_id", "type", F.get(F.get("series", F.lit(0))["values"], F.lit(0)).alias("first"), F.size(F.get("series", F.lit(0))["values"]).alias("n"))


@query("""SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS title, text = substring(text, 1) AS same FROM documents d""")
def front_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("---\ntitle: '"), F.col("lang"), F.lit("'\ndraft: true\n---\n"), F.col("text"))).otherwise(F.col("text"))
    meta, body = S.split_front_matter(F.col("raw"))
    marked = docs.withColumn("raw", text)
    return marked.select("doc_id", meta["title"].alias("title"), (F.md5(F.regexp_replace(body, r"^\s+", "")) == F.md5(F.regexp_replace("text", r"^\s+", ""))).alias("same"))


@query("""SELECT user_id, count(*) AS n FROM events WHERE value > 50 GROUP BY 1""")
def filtered_events(spark, sf_dir):
    return R.filter_rows(table(spark, sf_dir, "events"), F.col("value") > 50).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN '#DIV/0!' END AS err, CASE WHEN o_custkey % 4 = 0 THEN 2 END AS code FROM orders""")
def error_codes(spark, sf_dir):
    err = E.divide_error(F.col("o_totalprice"), F.col("o_custkey") % 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", err.alias("err"), E.error_number(err).alias("code"))


@query("""SELECT event_id, coalesce(num::VARCHAR, txt) AS shown FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id END AS num, event_type AS txt FROM events)""")
def mixed_order_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("double")).alias("num"), F.col("event_type").alias("txt"))
    return O.sort_values(rows, "num", "txt", "event_id").select("event_id", F.coalesce(F.col("num").cast("bigint").cast("string"), "txt").alias("shown"))
