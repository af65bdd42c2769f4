"""Readers and writers: sheets, Markdown, layouts, projects, tables and charts in Markdown, CSV and TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.typed import infer
from ..operators.cells import column_number, parse_ref

CELL = "struct<f:string,v:string,t:string,fmt:string,style:string,st:string,note:string>"
#: Project kinds by folder suffix (fixed values).
SUFFIXES = {".deck": "deck", ".doc": "doc", ".grid": "grid"}


def read_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file; the path as it is named, not as a URI writes it."""
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True).select(named.alias("path"), F.col("value").alias("text"))


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """`*.cells.json` sheets as cells: bad addresses dropped, shared styles expanded, empty cells left out."""
    raw = whole_texts(spark, path)
    schema = f"struct<id:string,name:string,styles:map<string,map<string,string>>,cells:map<string,{CELL}>>"
    sheets = raw.withColumn("j", F.from_json("text", schema)).withColumn("project_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).withColumn("sheet_id", F.coalesce("j.id", F.regexp_extract("path", r"([^/]+?)(\.cells)?\.json$", 1)))
    each = sheets.select("project_id", "sheet_id", "j.styles", F.explode("j.cells").alias("ref", "c")).withColumn("at", parse_ref(F.col("ref"))).filter("at IS NOT NULL")
    value, tag = F.col("c.v"), F.col("c.t")
    own = F.when(F.col("c.style").startswith("{"), F.from_json("c.style", "map<string,string>"))
    style = F.coalesce(own, F.col("styles")[F.coalesce("c.st", "c.style")])
    kind = F.when(tag.isNotNull(), tag).when(value.isNull(), F.lit(None)).when(value.isin("true", "false"), "b").when(value.try_cast("double").isNotNull(), "n").otherwise("s")
    cells = each.select(
        "project_id", "sheet_id", F.col("at.row").alias("row"), F.col("at.col").alias("col"), F.upper("ref").alias("ref"), F.col("c.f").alias("f"),
        F.when(kind.isin("n", "d"), value.try_cast("double")).alias("v_num"), F.when(kind.isin("s", "e"), value).alias("v_str"),
        F.when(kind == "b", F.lower(value) == "true").alias("v_bool"), kind.alias("t"), F.col("c.fmt").alias("fmt"), style.alias("style"),
    )
    return cells.filter("f IS NOT NULL OR v_num IS NOT NULL OR coalesce(v_str, '') <> '' OR v_bool IS NOT NULL OR style IS NOT NULL")


FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(map, body): flat `key: value` lines; without front matter an empty map."""
    yaml = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(yaml, "\r?\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)), r"^(['\"])(.*)\1$", "$2").alias("value")))
    # the last of equal keys counts
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last), F.regexp_replace(F.regexp_replace(text, FRONT, ""), r"\A(?:[ \t]*\r?\n)+", "")


def scan_markdown(spark: SparkSession, path: str) -> DataFrame:
    raw = whole_texts(spark, path)
    meta, body = split_front_matter(F.col("text"))
    return raw.select("path", meta.alias("meta"), body.alias("body"))


def scan_blocks(regions: DataFrame, layouts: DataFrame) -> DataFrame:
    """regions(item_id, block_id, md) with layouts(item_id, layout JSON {blocks: [{id, x, y, w, h, z, kind}]}): blocks without layout keep no geometry."""
    schema = "struct<blocks:array<struct<id:string,kind:string,x:double,y:double,w:double,h:double,z:double>>>"
    boxes = layouts.select("item_id", F.explode(F.from_json("layout", schema)["blocks"]).alias("b")).select("item_id", F.col("b.id").alias("block_id"), F.col("b.kind").alias("kind"), F.struct("b.x", "b.y", "b.w", "b.h", "b.z").alias("geom"))
    return regions.join(boxes, ["item_id", "block_id"], "left")


MANIFEST = "struct<format:string,version:string,id:string,title:string,created:string,modified:string,theme:string,entries:array<struct<id:string,name:string,md:string,json:string>>,_corrupt:string>"


def list_projects(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest, newest first; unreadable JSON gets a warning and the folder's name as title."""
    raw = whole_texts(spark, path)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    j = F.from_json("text", MANIFEST, {"columnNameOfCorruptRecord": "_corrupt"})
    kind = F.lit(None).cast("string")
    for suffix, name in SUFFIXES.items():
        kind = F.when(folder.endswith(suffix), F.lit(name)).otherwise(kind)
    bare = F.regexp_replace(folder, r"\.[a-z]+$", "")
    rows = raw.withColumn("j", j).select(folder.alias("folder"), kind.alias("type"), F.coalesce(F.nullif("j.title", F.lit("")), bare).alias("title"), "j.created", "j.modified", F.coalesce(F.size("j.entries"), F.lit(0)).alias("item_count"), F.col("j._corrupt").isNotNull().alias("warning"))
    return rows.orderBy(F.desc_nulls_last("modified"), "folder")


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes per project folder, history left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    suffixes = "|".join(s.lstrip(".") for s in SUFFIXES)
    return files.filter(~F.col("path").contains("/.history/")).withColumn("project", F.regexp_extract("path", rf"([^/]+\.(?:{suffixes}))/", 1)).groupBy("project").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count_if(F.col("path").contains("/assets/")).alias("assets"))


def asset_list(spark: SparkSession, path: str) -> DataFrame:
    """project, asset (its path below the assets folder), bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    found = rf"([^/]+\.(?:{'|'.join(s.lstrip('.') for s in SUFFIXES)}))/(?:.*/)?assets/(.+)$"
    kept = files.filter(~F.col("path").contains("/.history/") & F.col("path").rlike(found))
    return kept.select(F.regexp_extract("path", found, 1).alias("project"), F.regexp_extract("path", found, 2).alias("asset"), F.col("length").alias("bytes"))


def resolve_items(listed: DataFrame, files: DataFrame) -> DataFrame:
    """listed(project_id, item_no, md_path) and files(project_id, md_path) -> items in the listed order
    without missing files, then unlisted files by name."""
    both = listed.join(files.select("project_id", "md_path", F.lit(True).alias("_there")).distinct(), ["project_id", "md_path"], "full_outer").filter("_there")
    order = Window.partitionBy("project_id").orderBy(F.asc_nulls_last("item_no"), "md_path")
    return both.select("project_id", "md_path", F.row_number().over(order).alias("item_no"), F.col("item_no").isNotNull().alias("listed"))


def write_csv(df: DataFrame, path: str, bom: bool = True) -> None:
    """Header and rows with CRLF ends; quotes only where needed; a byte-order mark before the first name."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    out.write.options(header=True, lineSep="\r\n", escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated texts, each value typed."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"`{c}` string" for c in columns))
    return raw.withColumns({c: infer(F.col(c)) for c in columns})


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs and line ends inside values become blanks."""
    flat = df.select(*[F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "\t\n\r", "   ").alias(c) for c in df.columns])
    flat.write.options(sep="\t", header=True, emptyValue="", quote="\u0000").csv(path)


def extract_md_tables(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every Markdown table of a corpus: doc_id, table_no, row_no (0 is the header), values.

    A table is a run of piped lines whose second line is a rule with a dash; `\\|` stays in its
    cell; ragged rows are padded to the header's width."""
    lines = docs.select(F.col(id_column), F.posexplode(F.split(text, "\r?\n")).alias("no", "line")).filter(F.col("line").rlike(r"^[ \t]*\|"))
    island = F.col("no") - F.row_number().over(Window.partitionBy(id_column).orderBy("no"))
    runs = lines.withColumn("_i", island).withColumn("_n", F.row_number().over(Window.partitionBy(id_column, "_i").orderBy("no")) - 1)
    rule = F.col("line").rlike(r"^[ \t]*\|[ \t:|-]*-[ \t:|-]*$")
    run = Window.partitionBy(id_column, "_i")
    kept = runs.withColumn("_ok", F.bool_or(rule & (F.col("_n") == 1)).over(run)).filter(F.col("_ok") & (F.col("_n") != 1))
    inner = F.regexp_replace(F.trim("line"), r"^\||(?<!\\)\|$", "")
    values = F.transform(F.split(inner, r"(?<!\\)\|", -1), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    sized = kept.withColumn("values", values).withColumn("_w", F.max(F.when(F.col("_n") == 0, F.size("values"))).over(run))
    padded = F.slice(F.concat("values", F.array_repeat(F.lit(""), F.greatest(F.col("_w") - F.size("values"), F.lit(0)))), F.lit(1), F.col("_w"))
    return sized.select(id_column, F.dense_rank().over(Window.partitionBy(id_column).orderBy("_i")).alias("table_no"), F.when(F.col("_n") == 0, 0).otherwise(F.col("_n") - 1).alias("row_no"), padded.alias("values"))


def md_table_cells(tables: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Tables of `extract_md_tables` as cells: doc_id, table_no, row, col, value; empty cells are left out.

    A table with a blank corner, column letters above and row numbers (bold or not) at the side says
    itself where its cells are; any other lies at A1 with its header in row 1."""
    number = r"^\*{0,2}([0-9]+)\*{0,2}$"
    own = Window.partitionBy(id_column, "table_no")
    rest = F.slice("values", F.lit(2), F.greatest(F.size("values") - 1, F.lit(0)))
    lettered = (F.get("values", F.lit(0)) == "") & (F.size("values") > 1) & F.forall(rest, lambda x: x.rlike("^[A-Z]{1,3}$"))
    fits = F.when(F.col("row_no") == 0, lettered).otherwise(F.get("values", F.lit(0)).rlike(number))
    marked = tables.withColumn("_placed", F.bool_and(fits).over(own)).withColumn("_letters", F.max(F.when(F.col("row_no") == 0, F.col("values"))).over(own))
    each = marked.select(id_column, "table_no", "row_no", "_placed", "_letters", F.get("values", F.lit(0)).alias("_side"), F.posexplode("values").alias("_at", "value"))
    row = F.when(F.col("_placed"), F.regexp_extract("_side", number, 1).try_cast("int")).otherwise(F.col("row_no") + 1)
    col = F.when(F.col("_placed"), column_number(F.get("_letters", F.col("_at")))).otherwise(F.col("_at") + 1)
    kept = each.filter((F.col("value") != "") & (~F.col("_placed") | ((F.col("row_no") > 0) & (F.col("_at") > 0))))
    return kept.select(id_column, "table_no", row.alias("row"), col.alias("col"), "value")


CHART_KINDS = ("column", "bar", "line", "area", "pie", "donut", "scatter")
CHART = "struct<type:string,title:string,labels:array<string>,categories:array<string>,series:array<struct<name:string,values:array<string>>>,range:string,orientation:string>"


def extract_charts(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Charts of ```chart fences: an unknown type is a column chart, categories are labels, values that are no numbers are gaps."""
    found = docs.select(F.col(id_column), F.posexplode(F.regexp_extract_all(text, F.lit(r"(?ms)^```chart[^\n]*\n(.*?)^```"), F.lit(1))).alias("chart_no", "json"))
    read = found.withColumn("j", F.from_json("json", CHART)).filter("j IS NOT NULL")
    series = F.transform(F.col("j.series"), lambda s: F.struct(F.coalesce(s["name"], F.lit("")).alias("name"), F.transform(s["values"], lambda v: v.try_cast("double")).alias("values")))
    kind = F.when(F.lower("j.type").isin(*CHART_KINDS), F.lower("j.type")).otherwise("column")
    return read.select(id_column, "chart_no", F.concat_ws("#", F.col(id_column).cast("string"), "chart_no").alias("chart_id"), kind.alias("type"), F.col("j.title").alias("title"), F.coalesce("j.labels", "j.categories", F.array().cast("array<string>")).alias("labels"), F.coalesce(series, F.array().cast("array<struct<name:string,values:array<double>>>")).alias("series"), F.col("j.range").alias("range"), F.coalesce("j.orientation", F.lit("columns")).alias("orientation"))
