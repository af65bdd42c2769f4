"""Queries that write what they derive from the tables as files, and read it back through the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.lineage import checkpoint_dir
from ..operators import documents as D
from ..sources import files as S
from ..streaming import history as T
from ..streaming import store
from .registry import query, table
from .sheet import part_cells


def folder(spark) -> str:
    """A new folder in the place that all executors share."""
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def region_texts(spark, sf_dir, name, text):
    """One text file a region below `<region>.grid/`, made from its nations in order."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    packed = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = region.join(packed, F.col("r_regionkey") == F.col("n_regionkey")).select(F.concat("r_name", F.lit(".grid")).alias("folder"), text.alias("value"))
    path = folder(spark)
    rows.repartition("folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).text(f"{path}/{name}")
    return f"{path}/{name}"


@query("""SELECT 'folder=' || r_name || '.grid' AS project_id, lower(r_name) AS sheet_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS row, n_name AS v_str FROM nation JOIN region ON r_regionkey = n_regionkey""")
def scanned_sheets(spark, sf_dir):
    """Sheet files of each region's nations, read as cells."""
    cells = F.map_from_entries(F.transform("n", lambda x, i: F.struct(F.concat(F.lit("A"), (i + 1).cast("string")).alias("key"), F.struct(x["n_name"].alias("v")).alias("value"))))
    path = region_texts(spark, sf_dir, "sheets", F.to_json(F.struct(F.lower("r_name").alias("id"), F.col("r_name").alias("name"), cells.alias("cells"))))
    return S.scan_cells(spark, f"{path}/*/*.txt").select("project_id", "sheet_id", "row", "v_str")


@query("""SELECT 'folder=' || r_name || '.grid' AS folder, 'grid' AS type, r_name AS title, count(*)::INTEGER AS item_count, false AS warning FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def listed_projects(spark, sf_dir):
    """Manifests of each region, an entry a nation."""
    entries = F.transform("n", lambda x: F.struct(x["n_nationkey"].cast("string").alias("id"), x["n_name"].alias("name")))
    path = region_texts(spark, sf_dir, "manifests", F.to_json(F.struct(F.col("r_name").alias("title"), entries.alias("entries"))))
    return S.list_projects(spark, f"{path}/*/*.txt").select("folder", "type", "title", "item_count", "warning")


@query("""SELECT 'folder=' || r_name || '.grid' AS project, 1::BIGINT AS files, (len(r_name) + 1)::BIGINT AS bytes, 0::BIGINT AS assets FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)""")
def project_files(spark, sf_dir):
    """Files and bytes of projects that hold their region's name and a line end."""
    return S.file_inventory(spark, region_texts(spark, sf_dir, "names", F.col("r_name"))).select("project", "files", "bytes", "assets")


@query("""SELECT r_name AS title, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def markdown_files(spark, sf_dir):
    """Markdown files with front matter, read back."""
    names = F.array_join(F.transform("n", lambda x: x["n_name"]), "\n")
    path = region_texts(spark, sf_dir, "notes", F.concat(F.lit("---\ntitle: "), F.col("r_name"), F.lit("\n---\n\n"), names))
    return S.scan_markdown(spark, f"{path}/*/*.txt").select(F.col("meta")["title"].alias("title"), F.regexp_replace("body", r"\s+$", "").alias("body"))


@query("""SELECT p_partkey, p_name, round(p_retailprice, 2) AS price FROM part""")
def csv_round_trip(spark, sf_dir):
    """Parts written as CSV with a byte-order mark and read by Spark's own reader."""
    path = folder(spark)
    S.write_csv(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.round("p_retailprice", 2).alias("price")), path)
    return spark.read.csv(path, header=True, escape='"', schema="p_partkey bigint, p_name string, price double", enforceSchema=True)


@query("""SELECT c_name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def tsv_round_trip(spark, sf_dir):
    """Customers written as TSV and read with typed values; the header is a row of texts."""
    path = folder(spark)
    S.write_tsv(table(spark, sf_dir, "customer").select("c_name", "c_acctbal", "c_mktsegment"), path)
    read = S.read_tsv(spark, path, ["c_name", "c_acctbal", "c_mktsegment"]).filter("c_acctbal.t = 'n'")
    return read.select(F.col("c_name.str").alias("c_name"), F.col("c_acctbal.num").alias("balance"), F.col("c_mktsegment.str").alias("segment"))


@query("""SELECT 'slide' || user_id AS item_id, event_id::VARCHAR AS block_id, CASE WHEN event_id % 2 = 0 THEN value END AS w FROM events""")
def laid_out_blocks(spark, sf_dir):
    """Layouts of each user's even events; the odd ones keep no geometry."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("slide"), "user_id").alias("item_id"), F.col("event_id").cast("string").alias("block_id"), "event_id", "value", F.col("event_type").alias("md"))
    box = F.struct(F.col("block_id").alias("id"), F.lit("text").alias("kind"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.col("value").alias("w"), F.lit(4.0).alias("h"))
    layouts = events.filter("event_id % 2 = 0").groupBy("item_id").agg(F.to_json(F.struct(F.collect_list(box).alias("blocks"))).alias("layout"))
    return S.scan_blocks(events.select("item_id", "block_id", "md"), layouts).select("item_id", "block_id", F.col("geom.w").alias("w"))


PARTS_SQL = "(SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row FROM part)"


@query(f"""SELECT p_brand AS sheet_id, count(*) AS numbers, sum(p_size)::DOUBLE AS total FROM {PARTS_SQL} WHERE row % 10 <> 0 GROUP BY 1""")
def streamed_profiles(spark, sf_dir):
    """Cells of all parts' sheets, stored, streamed in and profiled by sheet."""
    path = folder(spark)
    cells = part_cells(spark, sf_dir).filter("col = 2 AND t = 'n'").select("project_id", "sheet_id", "row", "col", "v_num")
    cells.write.parquet(f"{path}/in")
    profile = lambda c: c.groupBy("project_id", "sheet_id").agg(F.count("v_num").alias("numbers"), F.sum("v_num").alias("total"))
    store.stream_cells(spark.readStream.schema(cells.schema).parquet(f"{path}/in"), profile, f"{path}/out", f"{path}/state").awaitTermination()
    return store.stored(spark, f"{path}/out", "profiles").select("sheet_id", "numbers", "total")


@query(f"""SELECT p_brand AS sheet_id, row::BIGINT AS row, (CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END)::DOUBLE AS v_num,
count(*) OVER (PARTITION BY p_brand) AS numbers, (sum(CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END) OVER (PARTITION BY p_brand))::DOUBLE AS total
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS row FROM part) WHERE p_partkey % 5 > 0""")
def streamed_updates(spark, sf_dir):
    """All parts' sizes as cells, then every third changed, every fifth deleted and every seventh sent again as it was
    long ago, the files of a change a batch: stored cells with the count and sum of their sheet's profile."""
    path = folder(spark)
    row = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    cells = table(spark, sf_dir, "part").select(F.lit("p").alias("project_id"), F.col("p_brand").alias("sheet_id"), row.cast("bigint").alias("row"), F.lit(2).alias("col"), F.col("p_size").cast("double").alias("v_num"), F.lit(1).alias("version"), F.lit(False).alias("deleted"), "p_partkey")
    changes = [
        cells,
        cells.filter("p_partkey % 3 = 0").withColumns({"v_num": F.col("v_num") + 100, "version": F.lit(3)}),
        cells.filter("p_partkey % 5 = 0").withColumns({"version": F.lit(4), "deleted": F.lit(True)}),
        cells.filter("p_partkey % 7 = 0").withColumn("version", F.lit(0)),
    ]
    for part in changes:
        part.drop("p_partkey").write.mode("append").parquet(f"{path}/in")
    # a batch rewrites the buckets it touches, so the number of batches does not grow with that of the files
    files = spark.read.parquet(f"{path}/in").select(F.input_file_name()).distinct().count()
    stream = spark.readStream.schema(cells.drop("p_partkey").schema).option("maxFilesPerTrigger", -(-files // len(changes))).parquet(f"{path}/in")
    profile = lambda c: c.groupBy("project_id", "sheet_id").agg(F.count("v_num").alias("numbers"), F.sum("v_num").alias("total"))
    store.stream_cells(stream, profile, f"{path}/out", f"{path}/state", ["version"], 8).awaitTermination()
    sheets = store.stored(spark, f"{path}/out", "profiles").select("project_id", "sheet_id", "numbers", "total")
    return store.stored(spark, f"{path}/out").join(sheets, ["project_id", "sheet_id"]).select("sheet_id", "row", "v_num", "numbers", "total")


@query("""SELECT doc_id, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS row, chr(65 + (i % 3)::INTEGER) AS col_name, word FROM (SELECT s_suppkey AS doc_id, unnest([s_name, s_nationkey::VARCHAR]) AS word, unnest([0, 1]) AS i FROM supplier) WHERE i = 0
UNION ALL SELECT s_suppkey, 2, 'B', s_nationkey::VARCHAR FROM supplier""")
def projected_tables(spark, sf_dir):
    """Tables that say themselves where their cells are: column letters above, bold row numbers at the side."""
    text = F.concat(F.lit("| | A | B |\n|---|---|---|\n| **1** | "), F.col("s_name"), F.lit(" | |\n| **2** | | "), F.col("s_nationkey").cast("string"), F.lit(" |\n"))
    cells = S.md_table_cells(S.extract_md_tables(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"), text.alias("text"))))
    return cells.select("doc_id", F.col("row").cast("bigint").alias("row"), F.char(64 + F.col("col")).alias("col_name"), F.col("value").alias("word"))


@query("""SELECT conv_id AS doc_id, role AS block_id, count(*)::BIGINT AS regions FROM (SELECT DISTINCT conv_id, CASE turn % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS role FROM conversations) GROUP BY 1, 2""")
def fenced_anchors(spark, sf_dir):
    """Anchors inside a fence are text, also behind a line of the other fence's mark."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("role")).distinct()
    text = F.concat(F.lit("<!-- block:"), F.col("role"), F.lit(" -->\n```\n~~~\n<!-- block:hidden -->\n```\nafter"))
    cut = D.anchored_regions(turns.withColumn("text", text).withColumn("doc_id", F.concat_ws("/", "doc_id", "role")))
    return cut.groupBy(F.substring_index("doc_id", "/", 1).cast("bigint").alias("doc_id"), "block_id").agg(F.count("*").alias("regions"))
