"""Sparse sheets as a long table of cells: addresses, ranges, regions, profiles, formulas.

cells(project_id, sheet_id, row, col, ref, f, v_num, v_str, v_bool, t, fmt, style); rows and
columns count from 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import pinned
from .lookups import in_areas

LAST_COLUMN, LAST_ROW = 16_384, 1_048_576
SHEET = ["project_id", "sheet_id"]
#: Labels of rows that add up others.
TOTAL_LABELS = ("합계", "총계", "소계", "누계", "계", "total", "subtotal", "sum")
NUMERIC_SHARE = 0.6


def column_name(col: Column) -> Column:
    """1 -> A, 27 -> AA: up to three letters."""
    c = col.cast("int")
    letter = lambda n: F.char((F.lit(65) + n).cast("int"))
    n2, n3 = F.floor((c - 1) / 26).cast("int"), F.floor((c - 27) / 676).cast("int")
    first = F.when(c > 702, letter(n3 - 1)).otherwise(F.lit(""))
    second = F.when(c > 26, letter((n2 - 1) % 26)).otherwise(F.lit(""))
    return F.concat(first, second, letter((c - 1) % 26))


def column_number(name: Column) -> Column:
    """A -> 1, AA -> 27."""
    letters = F.filter(F.split(F.upper(name), ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


REF = r"^\$?([A-Za-z]{1,3})\$?([0-9]{1,7})$"


def parse_ref(ref: Column) -> Column:
    """struct(row, col) of an address; NULL outside XFD1048576 or if it is none."""
    row, col = F.regexp_extract(ref, REF, 2).try_cast("int"), column_number(F.regexp_extract(ref, REF, 1))
    return F.when(ref.rlike(REF) & row.between(1, LAST_ROW) & (col <= LAST_COLUMN), F.struct(row.alias("row"), col.alias("col")))


def address(row: Column, col: Column, kind: int = 1, sheet: str | None = None) -> Column:
    """Kinds: 1 $A$1, 2 A$1, 3 $A1, 4 A1; NULL (#VALUE!) out of bounds."""
    out = F.concat(F.lit("$" if kind in (1, 3) else ""), column_name(col), F.lit("$" if kind in (1, 2) else ""), row.cast("string"))
    if sheet:
        out = F.concat(F.lit(sheet if re.fullmatch(r"\w+", sheet) else "'" + sheet.replace("'", "''") + "'"), F.lit("!"), out)
    return F.when(row.between(1, LAST_ROW) & col.between(1, LAST_COLUMN), out)


def shown() -> Column:
    """A cell's value as text."""
    whole = (F.col("v_num") == F.floor("v_num")) & (F.abs("v_num") < 1e15)
    number = F.when(whole, F.col("v_num").cast("decimal(20,0)").cast("string")).otherwise(F.col("v_num").cast("string"))
    return F.coalesce(F.col("v_str"), number, F.upper(F.col("v_bool").cast("string")))


def filled() -> Column:
    return F.coalesce(shown(), F.lit("")) != ""


def range_of(text: str) -> tuple[int, int, int, int]:
    """'B2:D9' -> (row0, col0, row1, col1), ordered."""
    parts = [re.fullmatch(r"\$?([A-Za-z]{1,3})\$?(\d+)", p) for p in text.split(":")]
    number = lambda s: sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(s.upper())))
    rows, cols = [int(p[2]) for p in parts], [number(p[1]) for p in parts]
    return min(rows), min(cols), max(rows), max(cols)


def slice_range(cells: DataFrame, area: str, row_shift: int = 0, col_shift: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells of a rectangle, or of it moved and resized, with `r` and `c` counted inside it."""
    r0, c0, r1, c1 = range_of(area)
    r0, c0 = r0 + row_shift, c0 + col_shift
    r1, c1 = r0 + (height or r1 - r0 + row_shift + 1) - 1 if height else r1 + row_shift, c0 + width - 1 if width else c1 + col_shift
    if r0 < 1 or c0 < 1:
        raise ValueError("#REF!")
    return cells.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).withColumns({"r": F.col("row") - r0 + 1, "c": F.col("col") - c0 + 1})


def selection_stats(cells: DataFrame, area: str) -> DataFrame:
    """Filled cells, numbers, sum and average of a rectangle, per sheet."""
    x = slice_range(cells, area)
    return x.groupBy(*SHEET).agg(F.count_if(filled()).alias("filled"), F.count("v_num").alias("numbers"), F.coalesce(F.sum("v_num"), F.lit(0.0)).alias("total"), F.avg("v_num").alias("average"))


def _used() -> Column:
    """Whether a cell has a value, a formula or a style."""
    return filled() | F.col("f").isNotNull() | (F.size(F.coalesce("style", F.create_map().cast("map<string,string>"))) > 0)


def used_range(cells: DataFrame) -> DataFrame:
    """Smallest rectangle of cells with a value, a formula or a style, per sheet."""
    return cells.filter(_used()).groupBy(*SHEET).agg(F.min("row").alias("r0"), F.min("col").alias("c0"), F.max("row").alias("r1"), F.max("col").alias("c1"))


def find_regions(cells: DataFrame) -> DataFrame:
    """Bands of rows with values, each an address over the used columns; found from the rows that
    exist, so the full grid is never built.  A sheet's rows are the distinct ones only."""
    rows = cells.filter(filled()).groupBy(*SHEET, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    island = F.col("row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    bands = rows.withColumn("_i", island).groupBy(*SHEET, "_i").agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    cols = used_range(cells).select(*SHEET, "c0", "c1")
    no = F.row_number().over(Window.partitionBy(*SHEET).orderBy("r0"))
    area = F.concat(column_name(F.col("c0")), F.col("r0").cast("string"), F.lit(":"), column_name(F.col("c1")), F.col("r1").cast("string"))
    return bands.join(cols, SHEET).withColumn("region", no).select(*SHEET, "region", "r0", "c0", "r1", "c1", area.alias("address"))


def region_rows(cells: DataFrame) -> DataFrame:
    """The rows with values, each with the number of its region and the region's first row: cells find theirs by row, whatever the number of regions."""
    rows = cells.filter(filled()).select(*SHEET, "row").distinct()
    island = F.col("row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row"))
    first = F.min("row").over(Window.partitionBy(*SHEET, "_i"))
    # islands ascend with the rows of a sheet
    return rows.withColumn("_i", island).select(*SHEET, "row", F.dense_rank().over(Window.partitionBy(*SHEET).orderBy("_i")).alias("region"), first.alias("r0"))


def _adds() -> Column:
    """Whether a cell marks its row as one that adds up others: a label in column 1, or a formula over its own column."""
    label = (F.col("col") == 1) & F.lower(F.trim(shown())).isin(*TOTAL_LABELS)
    own = column_name(F.col("col"))
    calls = F.regexp_extract_all(F.upper(F.col("f")), F.lit(r"\b(?:SUM|AVERAGE|COUNT|MAX|MIN)\(\$?([A-Z]{1,3})\$?[0-9]+:\$?[A-Z]{1,3}\$?[0-9]+\)"), F.lit(0))
    over = F.exists(calls, lambda x: (F.regexp_extract(x, r"\(\$?([A-Z]{1,3})", 1) == own) & (F.regexp_extract(x, r":\$?([A-Z]{1,3})", 1) == own))
    return F.coalesce(label, F.lit(False)) | F.coalesce(over, F.lit(False))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row a sheet's row, in one pass over the cells: whether it is used, holds values, and adds up others."""
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    return cells.groupBy(*SHEET, "row").agg(some(_used()).alias("used"), some(filled()).alias("full"), some(_adds()).alias("adds"))


def _header_rows(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    used = rows.filter("used").groupBy(*SHEET).agg(F.min("row").alias("r0"), F.max("row").alias("r1"))
    frozen = sheets.select("sheet_id", "frozen_rows")
    pick = F.when(F.coalesce(F.col("frozen_rows"), F.lit(0)) > 0, F.least(F.greatest(F.col("frozen_rows"), F.col("r0")), F.col("r1"))).otherwise(F.col("r0"))
    return used.join(frozen, "sheet_id", "left").select(*SHEET, pick.alias("header_row"), "r1")


def header_rows(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Last frozen row, else the first used row, kept inside the used range."""
    return _header_rows(sheet_rows(cells), sheets)


def looks_like_header(cells: DataFrame, first_row: int = 1) -> DataFrame:
    """Per sheet: every filled column has text over numbers, or a bold first row stands over a plain second."""
    top, rest = F.col("row") == first_row, F.col("row") > first_row
    bold = F.coalesce(F.col("style")["bold"] == "true", F.lit(False))
    by_col = cells.filter(filled() & (F.col("row") >= first_row)).groupBy(*SHEET, "col").agg(
        F.bool_or(top & (F.col("t") == "s")).alias("head"), F.bool_or(rest & (F.col("t") == "n")).alias("numbers"), F.bool_or(rest & (F.col("t") == "s")).alias("texts"),
        F.bool_or(top & bold).alias("bold"), F.bool_or((F.col("row") == first_row + 1) & bold).alias("bold2"),
    )
    return by_col.groupBy(*SHEET).agg((F.bool_and(F.col("head") & F.col("numbers")) | (F.bool_and("bold") & ~F.bool_or("bold2"))).alias("is_header"))


def total_rows(cells: DataFrame) -> DataFrame:
    """Rows that add up others: the label in column 1 says so, or a formula aggregates its own column."""
    return cells.filter(_adds()).select(*SHEET, "row").distinct()


def _scope(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    heads = _header_rows(rows, sheets)
    below = rows.join(heads, SHEET).filter("row >= header_row")
    # rows with values up to the first blank row below the header
    run = F.col("row") - F.col("header_row") - F.row_number().over(Window.partitionBy(*SHEET).orderBy("row")) + 1
    leading = below.filter("full").withColumn("_gap", run).filter("_gap = 0")
    ends = leading.groupBy(*SHEET, "header_row", "r1").agg(F.max("row").alias("last_row"), F.count_if(F.col("adds") & (F.col("row") > F.col("header_row"))).alias("left_out"))
    return ends.select(*SHEET, "header_row", (F.col("header_row") + 1).alias("first_row"), "last_row", "left_out", (F.col("r1") > F.col("last_row")).alias("cut_off"))


def summary_scope(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """First and last row that count, how many total rows are left out, and whether values follow below."""
    return _scope(sheet_rows(cells), sheets)


def column_profile(cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per column of the leading table without its total rows: header, type, count, sum, average, range.

    Numeric if at least 60 % of the filled cells are plain numbers; dates and errors are not.  Two passes over the
    cells: one for their rows, which are kept, and one for header and figures together."""
    rows = pinned(sheet_rows(cells))
    placed = cells.filter(filled()).join(_scope(rows, sheets), SHEET).filter("row BETWEEN header_row AND last_row")
    adding = rows.filter("adds").select(*SHEET, "row", "adds")
    marked = placed.join(adding, [*SHEET, "row"], "left")
    body = (F.col("row") >= F.col("first_row")) & F.col("adds").isNull()
    x = F.when(body & (F.col("t") == "n"), F.col("v_num"))
    header = F.max(F.when(F.col("row") == F.col("header_row"), shown()))
    stats = marked.groupBy(*SHEET, "col").agg(header.alias("header"), F.count_if(body).alias("filled"), F.count(x).alias("numbers"), F.sum(x).alias("total"), F.avg(x).alias("average"), F.min(x).alias("smallest"), F.max(x).alias("largest"))
    numeric = F.col("numbers") >= F.col("filled") * NUMERIC_SHARE
    out = stats.filter("filled > 0").withColumn("type", F.when(numeric, "number").otherwise("text"))
    keep = lambda c: F.when(numeric, F.col(c)).alias(c)
    return out.select(*SHEET, "col", "header", "type", "filled", "numbers", *[keep(c) for c in ("total", "average", "smallest", "largest")])


def region_profile(cells: DataFrame) -> DataFrame:
    """The same per region with four types: empty, number (no text at all), text, mixed."""
    placed = cells.filter(filled()).join(region_rows(cells), [*SHEET, "row"])
    heads = placed.filter("row = r0").select(*SHEET, "region", "col", shown().alias("header"))
    number = F.col("t").isin("n", "d")
    stats = placed.filter("row > r0").groupBy(*SHEET, "region", "col").agg(F.count("*").alias("filled"), F.count_if(number).alias("n"), F.count_if(F.col("t") == "s").alias("texts"), F.sum(F.when(number, F.col("v_num"))).alias("total"), F.avg(F.when(number, F.col("v_num"))).alias("average"), F.min(F.when(number, F.col("v_num"))).alias("smallest"), F.max(F.when(number, F.col("v_num"))).alias("largest"))
    kind = F.when(F.coalesce("filled", F.lit(0)) == 0, "empty").when((F.col("n") > 0) & (F.col("texts") == 0), "number").when(F.col("n") == 0, "text").otherwise("mixed")
    out = heads.join(stats, [*SHEET, "region", "col"], "full_outer").withColumn("type", kind)
    return out.select(*SHEET, "region", "col", "header", "type", "filled", *[F.when(F.col("type") == "number", F.col(c)).alias(c) for c in ("total", "average", "smallest", "largest")])


REFERENCE = r"(?<![A-Za-z0-9_.])(?:('[^']+'|[A-Za-z_][A-Za-z0-9_]*)!)?(\$?[A-Za-z]{1,3}\$?[0-9]{1,7})(?::(\$?[A-Za-z]{1,3}\$?[0-9]{1,7}))?(?![A-Za-z0-9_(])"


def formula_areas(cells: DataFrame) -> DataFrame:
    """Cell -> areas its formula reads (to_sheet, r0, c0, r1, c1, mention): `$` dropped, quoted text ignored, in order of mention."""
    bare = F.regexp_replace("f", '"[^"]*"', '""')
    found = cells.filter(F.col("f").isNotNull()).select(*SHEET, "row", "col", F.posexplode(F.regexp_extract_all(bare, F.lit(REFERENCE), F.lit(0))).alias("mention", "m"))
    sheet = F.regexp_extract("m", r"^(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_]*))!", 1)
    plain = F.regexp_extract("m", r"^([A-Za-z_][A-Za-z0-9_]*)!", 1)
    area = F.split(F.regexp_replace("m", r"^(?:'[^']+'|[A-Za-z_][A-Za-z0-9_]*)!", ""), ":")
    ends = found.withColumn("to_sheet", F.coalesce(F.nullif(sheet, F.lit("")), F.nullif(plain, F.lit("")), F.col("sheet_id"))).withColumn("a", parse_ref(F.get(area, F.lit(0)))).withColumn("b", parse_ref(F.coalesce(F.get(area, F.lit(1)), F.get(area, F.lit(0)))))
    box = [F.least("a.row", "b.row").alias("r0"), F.least("a.col", "b.col").alias("c0"), F.greatest("a.row", "b.row").alias("r1"), F.greatest("a.col", "b.col").alias("c1")]
    return ends.filter("a IS NOT NULL AND b IS NOT NULL").select(*SHEET, "row", "col", "to_sheet", "mention", *box)


def formula_edges(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Cell -> cells its formula reads, each once, with its first mention.

    Without `targets` every cell of an area counts, blank or not: for small areas.  With `targets`(project_id, sheet_id,
    row, col) only these count, met by tiles, so an area costs what lies in it and not what it covers;
    sheet names compare without case.  For `circular_cells` the cells with a formula are enough."""
    areas = formula_areas(cells)
    if targets is None:
        spread = areas.withColumn("to_row", F.explode(F.sequence("r0", "r1"))).withColumn("to_col", F.explode(F.sequence("c0", "c1")))
    else:
        there = targets.select("project_id", F.lower("sheet_id").alias("_sheet"), F.col("sheet_id").alias("_own"), "row", "col")
        asked = areas.withColumnsRenamed({"row": "_row", "col": "_col"}).withColumn("_sheet", F.lower("to_sheet"))
        met = in_areas(asked, there, ["project_id", "_sheet"])
        spread = met.select(*SHEET, F.col("_row").alias("row"), F.col("_col").alias("col"), F.col("_own").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), "mention")
    return spread.groupBy(*SHEET, "row", "col", "to_sheet", "to_row", "to_col").agg(F.min("mention").alias("mention"))


def function_usage(cells: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Functions called per sheet, with `known` (name) telling which are listed."""
    bare = F.regexp_replace("f", '"[^"]*"', '""')
    names = cells.filter(F.col("f").isNotNull()).select(*SHEET, F.explode(F.regexp_extract_all(F.upper(bare), F.lit(r"([A-Z][A-Z0-9.]*)\("), F.lit(1))).alias("name"))
    used = names.groupBy(*SHEET, "name").agg(F.count("*").alias("calls"))
    if known is None:
        return used
    return used.join(known.select("name", F.lit(True).alias("_k")).distinct(), "name", "left").withColumn("known", F.col("_k").isNotNull()).drop("_k")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges whose cell nothing reads or whose target reads nothing: they lie on no cycle."""
    read = edges.select(F.col("b").alias("a")).distinct()
    reading = edges.select(F.col("a").alias("b")).distinct()
    return edges.join(read, "a", "left_semi").join(reading, "b", "left_semi").select("a", "b")


def _shortened(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(edges, passed): cells of one edge in and one out are passed over, if they come first in a
    random order among their neighbours, so that chains shrink by a constant share.

    `passed` (v, u, w): u -> v -> w has become u -> w."""
    ins = edges.groupBy(F.col("b").alias("v")).agg(F.count("*").alias("n"), F.any_value("a").alias("u")).filter("n = 1")
    outs = edges.groupBy(F.col("a").alias("v")).agg(F.count("*").alias("n"), F.any_value("b").alias("w")).filter("n = 1")
    rank = lambda c: F.xxhash64(c, F.lit(salt))
    thin = ins.select("v", "u").join(outs.select("v", "w"), "v").filter("u <> v")
    passed = pinned(thin.filter((rank("v") < rank("u")) & (rank("v") < rank("w"))))
    gone = passed.select("v")
    rest = edges.join(gone.select(F.col("v").alias("a")), "a", "left_anti").join(gone.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b")
    return pinned(rest.unionByName(passed.select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct()), passed


def _spread(labels: DataFrame, edges: DataFrame, within: bool) -> DataFrame:
    """Labels (v, label) carried along edges a -> b to a fixed point; each cell keeps its smallest.

    `within`: edges are those of one label's own cells, and cells without a label get one."""
    while True:
        sent = edges.join(labels.select(F.col("v").alias("a"), "label"), "a").select(F.col("b").alias("v"), "label")
        if within:
            sent = sent.filter("v IS NOT NULL")
        new = pinned(labels.unionByName(sent).groupBy("v").agg(F.min("label").alias("label")))
        if not new.join(labels.withColumnRenamed("label", "_was"), "v", "left").filter("_was IS NULL OR label < _was").limit(1).count():
            return new
        labels = new


def circular_cells(edges: DataFrame) -> DataFrame:
    """Cells on reference cycles: those of a strongly connected component of several cells, or that read themselves.

    Ends are trimmed and chains shortened in turn, so rounds grow with the logarithm of a chain's
    length.  What is left is labelled with the smallest cell that reaches it, and the cells of a label
    that reach its namesake are a component; the rest is done again.  Each round is written to
    the checkpoint folder so that the plan stays short.  Cells passed over lie on a cycle
    if both their neighbours lie in one component."""
    at = lambda s, r, c: F.concat_ws("!", F.col("project_id"), F.lower(F.col(s)), F.col(r).cast("string"), F.col(c).cast("string"))
    left = pinned(edges.select(at("sheet_id", "row", "col").alias("a"), at("to_sheet", "to_row", "to_col").alias("b")).distinct())
    own = left.filter("a = b").select(F.col("a").alias("cell"))
    left = left.filter("a <> b")
    loops, trail, count = [own], [], left.count()
    while count:
        left, passed = _shortened(_trimmed(left), len(trail))
        loops.append(left.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("label")))
        left = left.filter("a <> b")
        trail.append(passed)
        now = left.count()
        if now == count:
            break
        count = now
    found = [x for x in loops[1:]]
    while count:
        cells = left.select(F.col("a").alias("v")).unionByName(left.select(F.col("b").alias("v"))).distinct()
        colour = _spread(pinned(cells.select("v", F.col("v").alias("label"))), left, False)
        same = left.join(colour.select(F.col("v").alias("a"), F.col("label").alias("x")), "a").join(colour.select(F.col("v").alias("b"), F.col("label").alias("y")), "b")
        inner = pinned(same.filter("x = y").select(F.col("b").alias("a"), F.col("a").alias("b")))
        back = _spread(pinned(colour.filter("v = label")), inner, True)
        several = back.join(back.groupBy("label").count().filter("count > 1").select("label"), "label", "left_semi").select("v", "label")
        found.append(several)
        left = pinned(_trimmed(left.join(back.select(F.col("v").alias("a")), "a", "left_anti").join(back.select(F.col("v").alias("b")), "b", "left_anti").select("a", "b")))
        count = left.count()
    spark = edges.sparkSession
    labels = spark.createDataFrame([], "v string, label string")
    for part in found:
        labels = labels.unionByName(part)
    for passed in reversed(trail):
        labels = pinned(labels.groupBy("v").agg(F.min("label").alias("label")))
        between = passed.join(labels.select(F.col("v").alias("u"), F.col("label").alias("x")), "u").join(labels.select(F.col("v").alias("w"), F.col("label").alias("y")), "w")
        labels = labels.unionByName(between.filter("x = y").select("v", F.col("x").alias("label")))
    return labels.select(F.col("v").alias("cell")).unionByName(own).distinct()


def formula_runs(cells: DataFrame, least: int = 4) -> DataFrame:
    """Runs of at least four cells down a column with the same formula shifted.

    References are rewritten relative to their cell, in native expressions: the pieces between
    references stay, each reference becomes its distance unless fixed by `$`."""
    ref = F.lit(r"\$?[A-Z]{1,3}\$?[0-9]{1,7}(?![A-Z0-9(])")
    up = F.upper("f")
    refs = F.regexp_extract_all(up, ref, F.lit(0))
    relative = F.transform(
        refs,
        lambda x: F.concat(
            F.when(x.startswith("$"), F.regexp_extract(x, r"^\$([A-Z]+)", 1)).otherwise(F.concat(F.lit("C["), (column_number(F.regexp_extract(x, r"([A-Z]+)", 1)) - F.col("col")).cast("string"), F.lit("]"))),
            F.when(x.rlike(r"[A-Z]\$"), F.regexp_extract(x, r"\$([0-9]+)$", 1)).otherwise(F.concat(F.lit("R["), (F.regexp_extract(x, r"([0-9]+)$", 1).cast("int") - F.col("row")).cast("string"), F.lit("]"))),
        ),
    )
    shape = F.concat_ws("|", F.regexp_replace(up, ref, F.lit("#")), F.array_join(relative, ","))
    marked = cells.filter(F.col("f").isNotNull()).withColumn("_shape", shape)
    island = F.col("row") - F.row_number().over(Window.partitionBy(*SHEET, "col", "_shape").orderBy("row"))
    runs = marked.withColumn("_i", island).groupBy(*SHEET, "col", "_shape", "_i").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"), F.min_by("f", "row").alias("f"))
    return runs.filter(F.col("n") >= least).select(*SHEET, "col", "first_row", "last_row", "n", "f")


def encode_styles(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with `style_id`, dictionary): styles used twice or more get st1, st2, ... by use."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("style"))))
    keyed = cells.withColumn("_key", F.when(F.size("style") > 0, key))
    shared = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("n"), F.first("style").alias("style")).filter("n >= 2")
    named = shared.withColumn("style_id", F.concat(F.lit("st"), F.row_number().over(Window.orderBy(F.desc("n"), "_key")).cast("string")))  # a row a style
    coded = keyed.join(named.select("_key", "style_id"), "_key", "left").withColumn("style", F.when(F.col("style_id").isNull(), F.col("style"))).drop("_key")
    return coded, named.select("style_id", "style")


def decode_styles(coded: DataFrame, dictionary: DataFrame) -> DataFrame:
    known = dictionary.select("style_id", F.col("style").alias("_s"))
    return coded.join(known, "style_id", "left").withColumn("style", F.coalesce("style", "_s")).drop("_s", "style_id")


def records(cells: DataFrame, sheets: DataFrame, cut: int = 500) -> DataFrame:
    """Retrieval text per row below the header: `N행: header=value, ...`, blank cells left out."""
    tidy = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"([*_`])", r"\\$1")
    clip = lambda x: F.when(F.length(x) > cut, F.concat(F.substring(x, 1, cut), F.lit("… (전체 "), F.length(x).cast("string"), F.lit("자)"))).otherwise(x)
    heads = header_rows(cells, sheets).select(*SHEET, "header_row")
    placed = cells.filter(filled()).join(heads, SHEET)
    names = placed.filter("row = header_row").select(*SHEET, "col", tidy(shown()).alias("header"))
    body = placed.filter("row > header_row").join(names, [*SHEET, "col"], "left")
    pair = F.concat(F.coalesce("header", column_name(F.col("col"))), F.lit("="), clip(tidy(shown())))
    rows = body.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct(F.col("col").alias("c"), pair.alias("p")))).alias("s"))
    return rows.select(*SHEET, "row", F.concat(F.col("row").cast("string"), F.lit("행: "), F.array_join(F.transform("s", lambda x: x["p"]), ", ")).alias("record"))
