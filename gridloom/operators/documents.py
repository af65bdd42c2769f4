"""Markdown corpora: blocks, plain text, outlines, the addressed tree, rules and digests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import join_alike
from .cells import column_name, column_profile, filled, find_regions, parse_ref, records, region_profile, shown
from .lookups import positions
from .ordered import slug_dedupe

#: Characters of a summary, nodes of a map.
SUMMARY_CHARS, MAP_NODES = 180, 400
BLOCKS = T.ArrayType(T.StructType([T.StructField("block_type", T.StringType()), T.StructField("md", T.StringType())]))
#: Line kinds by pattern, the first that fits.
LINE_KINDS = [
    ("heading", re.compile(r"#{1,6}[ \t]+\S")),
    ("hr", re.compile(r"[ \t]{0,3}([-*_])([ \t]*\1){2,}[ \t]*$")),
    ("list", re.compile(r"[ \t]*([-*+]|\d{1,9}[.)])[ \t]+")),
    ("table", re.compile(r"[ \t]*\|")),
    ("quote", re.compile(r"[ \t]{0,3}>")),
]
FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
ALONE = ("heading", "hr")


def line_kinds(lines: Sequence[str]) -> list[str]:
    """One kind a line; a fence with all it holds is `code1`, `code2`, ..."""
    kinds, fence, n = [], None, 0
    for line in lines:
        if fence:
            kinds.append(f"code{n}")
            fence = None if line.lstrip().startswith(fence) else fence
        elif opened := FENCE.match(line):
            n += 1
            fence = opened[1][0] * 3
            kinds.append(f"code{n}")
        elif not line.strip(" \t\r"):
            kinds.append("blank")
        else:
            kinds.append(next((k for k, p in LINE_KINDS if p.match(line)), "text"))
    return kinds


def split_markdown(text: str | None) -> list[tuple[str, str]]:
    """(type, markdown) of the blocks of a text; a no-break space is not blank."""
    lines = [x.removesuffix("\r") for x in (text or "").split("\n")]
    # a block number for every line: runs of one kind share it, plain lines go on in lists and quotes
    block, last, numbers = 0, "blank", []
    for kind in line_kinds(lines):
        goes_on = kind == last and kind not in ALONE or kind == "text" and last in ("list", "quote") or last == "text" and kind in ("list", "table", "quote")
        block += not goes_on
        last = last if goes_on and kind == "text" else kind
        numbers.append((block, last))
    out = []
    for _, rows in groupby(zip(numbers, lines), key=lambda x: x[0][0]):
        rows = list(rows)
        kind = rows[-1][0][1]
        md = "\n".join(line for _, line in rows).rstrip(" \t\r\n")
        if kind != "blank" and md:
            kind = "code" if kind.startswith("code") else "image" if kind == "text" and IMAGE.fullmatch(md.strip()) else "paragraph" if kind == "text" else kind
            out.append((kind, md))
    return out


#: Texts whose pieces a Python worker holds at a time, however many rows a batch has.
SLICE = 256


def by_slices(batches: Iterator[pd.Series], cut) -> Iterator[pd.Series]:
    """`cut` of each text, given back slice by slice."""
    for texts in batches:
        for at in range(0, max(len(texts), 1), SLICE):
            yield texts.iloc[at : at + SLICE].map(cut)


@F.pandas_udf(BLOCKS)
def _blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return by_slices(batches, lambda x: [{"block_type": k, "md": m} for k, m in split_markdown(x)])


def split_blocks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, block_type, md: the top-level blocks of each document, in order."""
    return docs.select(F.col(id_column), F.posexplode(_blocks(F.col(text))).alias("pos", "b")).select(id_column, "pos", "b.block_type", "b.md")


ANCHOR = r"^\s*<!--\s*block:([A-Za-z0-9_-]+)\s*(\|([^>]*?))?\s*-->\s*$"


REGIONS = T.ArrayType(T.StructType([T.StructField("block_id", T.StringType()), T.StructField("options", T.StringType()), T.StructField("md", T.StringType())]))


def cut_regions(text: str | None) -> list[dict]:
    """Regions of a text at its anchor lines; a fence is closed by its own mark only."""
    lines = (text or "").split("\n")
    out, head, body = [], (None, None), []
    for line, kind in [*zip(lines, line_kinds(lines)), (None, "")]:
        anchor = None if line is None or kind.startswith("code") else re.match(ANCHOR, line)
        if line is None or anchor:
            md = "\n".join(body)
            if head[0] is not None or md.strip(" "):
                out.append({"block_id": head[0], "options": head[1], "md": md})
            head, body = (anchor[1], anchor[3]) if anchor else head, []
        else:
            body.append(line)
    return out


@F.pandas_udf(REGIONS)
def _regions(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return by_slices(batches, cut_regions)


def anchored_regions(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, region, block_id, options, md: texts between `<!-- block:id | k=v -->` lines; such
    lines inside fences count as text; a second equal id gets a suffix; text before the first has no id."""
    cut = docs.select(F.col(id_column), F.posexplode(_regions(F.col(text))).alias("at", "r"))
    # numbered from 0 if the text begins before the first anchor, else from 1
    bare = F.max(F.col("r.block_id").isNull().cast("int")).over(Window.partitionBy(id_column))
    kept = cut.select(id_column, (F.col("at") + 1 - bare).alias("region"), "r.block_id", "r.options", "r.md")
    pairs = F.when(F.trim("options") != "", F.str_to_map(F.trim("options"), F.lit(r"\s+"), F.lit("=")))
    named = slug_dedupe(kept.withColumn("options", pairs), "block_id", [id_column], "region", "_id")
    return named.withColumn("block_id", F.when(F.col("block_id").isNotNull(), F.col("_id"))).drop("_id")


def region_blocks(regions: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Regions cut into blocks: the id and the options stay with a region's first block."""
    cut = regions.select(id_column, "region", "block_id", "options", F.posexplode(_blocks(F.col("md"))).alias("at", "b"))
    own = lambda c: F.when(F.col("at") == 0, F.col(c)).alias(c)
    place = F.row_number().over(Window.partitionBy(id_column).orderBy("region", "at")) - 1
    return cut.select(id_column, place.alias("pos"), "region", own("block_id"), own("options"), "b.block_type", "b.md")


#: The patterns that turn Markdown into plain text, in their fixed order.  Digits are
#: any decimal digits, written as a class since `\d` means ASCII digits to some engines.
PLAIN_REWRITES = [
    (r"(?s)```.*?```", " "),
    (r"`([^`]*)`", "$1"),
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^[ \t]*#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*>[ \t]?", ""),
    (r"(?m)^[ \t]*(?:[-+*]|\p{Nd}+[.)])[ \t]+", ""),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"~~([^~]*)~~", "$1"),
    (r"</?(?:span|u)\b[^>]*>", ""),
    (r"(?m)^[ \t]*\|", ""),
    (r"\\([!-/:-@\[-`{-~])", "$1"),
    (r"\|", " "),
    (r"[ \t]+", " "),
    (r"^\s+|\s+$", ""),
]


#: What a text must hold for the rewrite at the same place to change it; None: not told so easily.
NEEDED = ("```", "`", "![", "](", "#", ">", None, "**", "*", "~~", "<", "|", "\\", "|", None, None)


def bound(value: Column, body) -> Column:
    """Evaluate a column once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_text(md: Column) -> Column:
    """Markdown without its marks; rewrites that cannot change a text are skipped."""
    out = F.coalesce(md, F.lit(""))
    for (pattern, new), mark in zip(PLAIN_REWRITES, NEEDED):
        if mark is None:
            out = F.regexp_replace(out, pattern, new)
        else:
            out = bound(out, lambda t: F.when(t.contains(mark), F.regexp_replace(t, pattern, new)).otherwise(t))  # noqa: B023
    return out


#: Characters that are words of their own, in this order: Hangul jamo, CJK
#: punctuation, kana, Hangul compatibility jamo, Hangul syllables, CJK unified ideographs.
CJK = r"[\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FFF}]"


def count_words(md: Column) -> Column:
    return bound(plain_text(md), lambda t: F.regexp_count(t, F.lit(CJK)) + F.regexp_count(t, F.lit(r"[A-Za-z0-9'’-]+")))


def heading_level(md: Column) -> Column:
    """1 to 6, or 0."""
    return F.length(F.regexp_extract(F.trim(md), r"^(#{1,6})[ \t]+", 1))


#: Characters a label does without, and the mark of a list at its beginning.
LABEL_MARKS, LABEL_BULLET = r"[*_`>#]", r"(?U)^[-+*]\s+"
#: Blanks of any alphabet at both ends; lines end at line feeds only.
OUTER_BLANKS = r"(?U)^\s+|\s+$"


def block_label(md: Column, limit: int) -> Column:
    """What an outline shows of a block: the text of its first heading, else its first line that is not blank.

    Images and links give their text, characters of markup go wherever they stand (also inside a word), a
    bullet at the beginning goes, a number stays; longer than the limit, the last character is an ellipsis."""
    trimmed = F.regexp_replace(F.coalesce(md, F.lit("")), OUTER_BLANKS, "")
    heading = F.regexp_extract(trimmed, r"(?md)^#{1,6}[ \t]+(.+)$", 1)
    first = F.regexp_extract(trimmed, r"(?d)^.*", 0)
    linked = F.regexp_replace(F.regexp_replace(F.when(heading != "", heading).otherwise(first), r"!\[([^\]]*)\]\([^)]*\)", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    # a bullet `*` is gone with the other marks, the blank behind it by the trim
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(linked, LABEL_MARKS, ""), LABEL_BULLET, ""), OUTER_BLANKS, "")
    return bound(plain, lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 1), F.lit("…"))).otherwise(t))


def infer_kind(block_type: Column, md: Column) -> Column:
    """text, table, image or chart, from the type that `split_blocks` gives."""
    return F.when((block_type == "code") & F.ltrim(md).startswith("```chart"), "chart").when(block_type.isin("table", "image"), block_type).otherwise("text")


def parse_area(area: Column) -> Column:
    """struct(r0, c0, r1, c1) of an address such as B2 or B2:D9; NULL if it is none."""
    ends = F.split(F.upper(F.replace(area, F.lit("$"), F.lit(""))), ":")
    a, b = parse_ref(F.get(ends, F.lit(0))), parse_ref(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))))
    box = F.struct(F.least(a["row"], b["row"]).alias("r0"), F.least(a["col"], b["col"]).alias("c0"), F.greatest(a["row"], b["row"]).alias("r1"), F.greatest(a["col"], b["col"]).alias("c1"))
    return F.when((F.size(ends) <= 2) & a.isNotNull() & b.isNotNull(), box)


def table_shape(md: Column) -> Column:
    """struct(rows, columns, header): data rows and columns of a Markdown table."""
    lines = F.filter(F.split(F.trim(md), "\n"), lambda x: x.rlike(r"\|"))
    rule = F.exists(lines, lambda x: x.rlike(r"^[ \t]*\|?[ \t:|-]*-[ \t:|-]*$"))
    width = F.size(F.split(F.regexp_replace(F.trim(F.get(lines, F.lit(0))), r"^\||\|$", ""), r"(?<!\\)\|"))
    return F.struct((F.size(lines) - F.when(rule, 2).otherwise(0)).alias("rows"), width.alias("columns"), rule.alias("header"))


def anchor_slug(text: Column) -> Column:
    """Small letters, blanks to dashes, only letters, digits, `_` and dashes; nothing left: 제목."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "-"), r"[^\p{L}\p{N}_-]", ""), r"^-+|-+$", "")
    return F.when(slug == "", F.lit("제목")).otherwise(slug)


def outline(blocks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Headings with level, text and anchor; equal anchors are numbered."""
    heads = blocks.withColumn("level", heading_level(F.col("md"))).filter("level > 0").withColumn("title", plain_text(F.col("md"))).filter("title <> ''")
    return slug_dedupe(heads.withColumn("slug", anchor_slug(F.col("title"))), "slug", [id_column], "pos").select(id_column, "pos", "level", "title", "anchor")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def slugify(title: Column, fallback: Column) -> Column:
    """Folder-safe title: composed, without characters a file name cannot hold, dashes for blanks, 60 characters."""
    kept = F.regexp_replace(nfc(F.coalesce(title, F.lit(""))), r'[/\\?%*:|"<>.]', "")
    slug = F.regexp_replace(F.lower(F.regexp_replace(kept, r"(?U)[\s-]+", "-")), r"^-+", "")
    slug = F.regexp_replace(F.substring(slug, 1, 60), r"-+$", "")
    return F.when(slug == "", fallback).otherwise(slug)


def position_phrase(x: Column, y: Column, w: Column, h: Column, width: float = 1280.0, height: float = 720.0) -> Column:
    """Place and width of a box in words."""
    cx, cy = (x + w / 2) / width, (y + h / 2) / height
    v = F.when(cy < 0.28, "상단").when(cy < 0.68, "중앙").otherwise("하단")
    s = F.when(cx < 0.3, "좌측").when(cx < 0.7, "중앙").otherwise("우측")
    share = F.floor(w / width * 100 + 0.5).cast("int")
    size = F.when(share >= 85, F.lit("전체 폭")).when(share <= 35, F.lit("좁은 폭")).otherwise(F.concat(F.lit("폭 "), share.cast("string"), F.lit("%")))
    return F.concat(F.when((v == "중앙") & (s == "중앙"), F.lit("정중앙")).otherwise(F.concat_ws(" ", v, s)), F.lit(", "), size)


def reading_order(blocks: DataFrame, by: str, id_column: str, tolerance: float = 40.0) -> DataFrame:
    """Row bands by y (a band begins more than the tolerance below the first y of the one before), then x.

    The heights of a slide's blocks are read as a sorted stream that holds the top of the current band only, so a
    slide of any size needs the memory of a batch.  Blocks without y come first, in a band of their own."""
    kind = blocks.schema[by].dataType.simpleString()
    tops = blocks.select(F.col(by).alias("s"), F.col("y").cast("double").alias("y")).filter("y IS NOT NULL").distinct()

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slide, top, number = object(), 0.0, 0
        for batch in batches:
            out = []
            for s, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != slide:
                    slide, top, number = s, y, 0
                elif y > top + tolerance:
                    top, number = y, number + 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=["s", "y", "band"])

    found = tops.repartition("s").sortWithinPartitions("s", "y").mapInArrow(bands, f"s {kind}, y double, band int")
    placed = blocks.select(F.col(by), F.col(id_column), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = placed.join(found.select(F.col("s").alias("_s"), F.col("y").alias("_y"), "band"), F.col(by).eqNullSafe(F.col("_s")) & (F.col("y") == F.col("_y")), "left").withColumn("band", F.coalesce("band", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(by).orderBy("band", "x", "y", id_column)) - 1
    return met.select(by, id_column, place.alias("place"), "band")


def heading_parents(blocks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """parent_pos: a plain block's nearest heading above; a heading's nearest earlier shallower heading.

    depth: 1 and one more for every heading around it; order_key: their positions, outermost first, and the own one."""
    levelled = blocks.withColumn("level", heading_level(F.col("md")))
    before = Window.partitionBy(id_column).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col("level") == k, F.col("pos")), ignorenulls=True).over(before) for k in range(1, 7)}
    marked = levelled.withColumns({f"_h{k}": c for k, c in last.items()})
    shallower = [F.when((F.col("level") == 0) | (F.col("level") > k), F.col(f"_h{k}")) for k in range(1, 7)]
    around = []
    for k in range(1, 7):
        # a heading is still open unless a shallower one came after it
        outer = F.coalesce(F.greatest(F.lit(-1), *[F.col(f"_h{j}") for j in range(1, k)]) if k > 1 else F.lit(-1), F.lit(-1))
        around.append(F.when(F.coalesce(shallower[k - 1] > outer, F.lit(False)), F.col(f"_h{k}")))
    key = F.concat(F.filter(F.array(*around), lambda x: x.isNotNull()), F.array("pos")).cast("array<bigint>")
    marked = marked.withColumn("order_key", key).withColumn("depth", F.size("order_key"))
    return marked.withColumn("parent_pos", F.greatest(*shallower)).drop(*[f"_h{k}" for k in range(1, 7)])


def level_skips(blocks: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Headings more than one level deeper than the heading before."""
    heads = blocks.withColumn("level", heading_level(F.col("md"))).filter("level > 0")
    before = F.lag("level").over(Window.partitionBy(id_column).orderBy("pos"))
    return heads.withColumn("previous", before).filter("previous IS NOT NULL AND level > previous + 1").select(id_column, "pos", "previous", "level")


def group_ordinals(blocks: DataFrame, by: str, pos: str = "pos", group: str = "group") -> DataFrame:
    """Drawn groups (an array of nested names a block) numbered by first appearance, with their blocks."""
    steps = blocks.filter(F.size(group) > 0).select(by, pos, F.posexplode(group).alias("depth", "name"), group).withColumn("path", F.array_join(F.slice(group, F.lit(1), F.col("depth") + 1), "/"))
    first = steps.groupBy(by, "path", "depth").agg(F.min(pos).alias("first"), F.count("*").alias("blocks"))
    return first.withColumn("ordinal", F.dense_rank().over(Window.partitionBy(by).orderBy("first", "depth", "path")))


def summary(text: Column, limit: int = SUMMARY_CHARS) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


NODE = ["path", "parent_path", "depth", "ord", "kind", "title", "summary", "chars", "content", "source", "order_key"]


def node(path: Column, parent: Column | None, depth: Column | int, order: Column | int, kind: Column | str, title: Column, text: Column, content: Column | None, source: Column, key: Column | None = None) -> list[Column]:
    """The columns of a node; the summary is the bounded text.

    order_key holds the ordinals from below the root (which has none) down to the node: arrays in
    their own order are the tree in pre-order, whatever the kind of source."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    made = [path, none if parent is None else parent, lit(depth).cast("int"), lit(order).cast("int"), lit(kind), title, summary(F.coalesce(text, F.lit(""))), F.length(F.coalesce(none if content is None else content, F.lit(""))), none if content is None else content, source, (F.array() if key is None else key).cast("array<bigint>")]
    return [c.alias(n) for c, n in zip(made, NODE)]


def with_counts(nodes: DataFrame) -> DataFrame:
    """Adds child_count."""
    counts = nodes.filter("parent_path IS NOT NULL").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("child_count"))
    return nodes.join(counts, "path", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def build_nodes(projects: DataFrame, blocks: DataFrame) -> DataFrame:
    """projects(doc_id, title) and blocks(doc_id, pos, block_type, md) -> the addressed tree of documents.

    path, parent_path, depth, ord, kind, title, summary, chars, child_count, content, source, order_key.  Headings
    are addressed by anchor, other blocks by position below their heading; depth is that of the tree."""
    root = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    placed = heading_parents(blocks)
    anchors = outline(blocks).select("doc_id", "pos", "anchor")
    named = placed.join(anchors, ["doc_id", "pos"], "left")
    own = F.concat(root, F.lit("/"), F.coalesce(F.concat(F.lit("h/"), F.col("anchor")), F.concat(F.lit("b/"), F.col("pos").cast("string"))))
    body = named.withColumn("path", own)
    parents = body.select("doc_id", F.col("pos").alias("parent_pos"), F.col("path").alias("_parent"))
    body = body.join(parents, ["doc_id", "parent_pos"], "left").withColumn("_parent", F.coalesce("_parent", root))
    md = F.col("md")
    kind = F.when(F.col("level") > 0, "heading").otherwise(F.col("block_type"))
    rows = body.select(*node(F.col("path"), F.col("_parent"), F.col("depth"), F.col("pos"), kind, block_label(md, 60), plain_text(md), md, root, F.col("order_key")))
    heads = projects.select(*node(root, None, 0, 0, "document", F.col("title"), F.col("title"), None, root))
    return with_counts(heads.unionByName(rows))


def slide_nodes(slides: DataFrame, blocks: DataFrame, groups: str = "group") -> DataFrame:
    """slides(slide_id, title) and blocks(slide_id, block_id, pos, md, group array<string>) -> slides, their drawn groups and blocks.

    A block lies below its innermost group, a group below the one around it."""
    root = F.concat(F.lit("slide/"), F.col("slide_id").cast("string"))
    at = lambda depth: F.concat(root, F.lit("/group/"), F.array_join(F.slice(F.col(groups), F.lit(1), depth), "/"))
    size, md = F.greatest(F.coalesce(F.size(groups), F.lit(0)), F.lit(0)), F.col("md")
    heads = slides.select(*node(root, None, 0, 0, "slide", F.col("title"), F.col("title"), None, root))
    steps = blocks.filter(F.size(groups) > 0).select("slide_id", "pos", groups, F.posexplode(groups).alias("k", "name"))
    inner = steps.select("slide_id", "pos", at(F.col("k") + 1).alias("path"), F.when(F.col("k") == 0, root).otherwise(at(F.col("k"))).alias("up"), (F.col("k") + 1).alias("deep"), "name", root.alias("root"))
    boxes = inner.groupBy("slide_id", "path", "up", "deep", "name", "root").agg(F.min("pos").alias("first"))
    # where each group around stands: the first positions of a slide's groups, by path (a row a group)
    firsts = boxes.groupBy("slide_id").agg(F.map_from_entries(F.collect_set(F.struct("path", "first"))).alias("firsts"))
    keyed = lambda depth: F.transform(F.sequence(F.lit(1), depth), lambda d: F.element_at("firsts", at(d)))
    named_groups = blocks.filter(F.size(groups) > 0).select("slide_id", groups, F.explode(F.sequence(F.lit(1), F.size(groups))).alias("deep")).select("slide_id", at(F.col("deep")).alias("path"), F.slice(F.col(groups), F.lit(1), F.col("deep")).alias(groups), "deep").dropDuplicates(["slide_id", "path"])
    keys = named_groups.join(firsts, "slide_id").select("path", keyed(F.col("deep")).alias("key"))
    drawn = boxes.join(keys, "path").select(*node(F.col("path"), F.col("up"), F.col("deep"), F.col("first"), "group", F.col("name"), F.col("name"), None, F.col("root"), F.col("key")))
    own = F.when(size > 0, F.concat(keyed(size), F.array("pos"))).otherwise(F.array("pos"))
    body = blocks.join(firsts, "slide_id", "left").select(*node(F.concat(root, F.lit("/block/"), F.col("block_id").cast("string")), F.when(size > 0, at(size)).otherwise(root), size + 1, F.col("pos"), "block", block_label(md, 60), plain_text(md), md, root, own))
    return with_counts(heads.unionByName(drawn).unionByName(body))


def sheet_nodes(cells: DataFrame, sheets: DataFrame, names: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """Sheets, their regions with columns, and names(sheet_id, name, target) and charts(sheet_id, chart_id, title, range) of a sheet.

    A region's summary says its address, a column's its type and figures."""
    root = F.concat(F.lit("sheet/"), F.col("sheet_id").cast("string"))
    region = F.concat(root, F.lit("/region/"), F.col("region").cast("string"))
    heads = sheets.select(*node(root, None, 0, 0, "sheet", F.col("name"), F.col("name"), None, root))
    parts = find_regions(cells).select(*node(region, root, 1, F.col("region"), "region", F.col("address"), F.col("address"), None, root, F.array(F.lit(0), F.col("region"))))
    figures = F.when(F.col("type") == "number", F.concat_ws(", ", F.concat(F.lit("count "), F.col("filled").cast("string")), F.concat(F.lit("sum "), F.col("total").cast("string")), F.concat(F.lit("average "), F.col("average").cast("string"))))
    title = F.coalesce("header", column_name(F.col("col")))
    columns = region_profile(cells).select(*node(F.concat(region, F.lit("/column/"), column_name(F.col("col"))), region, 2, F.col("col"), "column", title, F.concat_ws(": ", "type", figures), None, root, F.array(F.lit(0), F.col("region"), F.col("col"))))
    out = heads.unionByName(parts).unionByName(columns)
    if names is not None:
        no = F.row_number().over(Window.partitionBy("sheet_id").orderBy("name"))
        out = out.unionByName(names.withColumn("_no", no).select(*node(F.concat(root, F.lit("/name/"), F.col("name")), root, 1, F.col("_no"), "name", F.col("name"), F.col("target"), F.col("target"), root, F.array(F.lit(1), F.col("_no")))))
    if charts is not None:
        no = F.row_number().over(Window.partitionBy("sheet_id").orderBy("chart_id"))
        out = out.unionByName(charts.withColumn("_no", no).select(*node(F.concat(root, F.lit("/chart/"), F.col("chart_id").cast("string")), root, 1, F.col("_no"), "chart", F.col("title"), F.concat_ws(" ", "title", "range"), F.col("range"), root, F.array(F.lit(2), F.col("_no")))))
    return with_counts(out)


def with_intervals(nodes: DataFrame) -> DataFrame:
    """Adds low and high: a node's place in pre-order over all sources, and the last place below it.

    Places are numbered by ranges of (source, order_key), the sizes of subtrees counted from below: each node
    counts once for every node above it.  Kept as a table, a subtree is one range of it."""
    placed = positions(nodes, ["source", "order_key", "path"]).withColumnRenamed("position", "low")
    above = placed.select("source", F.explode(F.transform(F.sequence(F.lit(0), F.size("order_key")), lambda k: F.slice("order_key", F.lit(1), k))).alias("order_key"))
    sizes = above.groupBy("source", "order_key").agg(F.count("*").alias("_size"))
    return placed.join(sizes, ["source", "order_key"]).withColumn("high", F.col("low") + F.col("_size") - 1).drop("_size")


def subtree(nodes: DataFrame, path: str, depth: int = 6) -> DataFrame:
    """A node and its descendants down to a depth, with `below`, the levels between.

    The node is looked up, then its interval is one range filter over `nodes`; they are labelled first if
    they come without low and high."""
    labelled = nodes if "low" in nodes.columns else with_intervals(nodes)
    top = labelled.filter(F.col("path") == path).select("low", "high", "depth").first()
    low, high, start = top or (0, -1, 0)
    below = F.col("depth") - start
    found = labelled.filter(F.col("low").between(low, high)).withColumn("below", below).filter(F.col("below") <= depth)
    return found.select(*nodes.columns, "below")


def cell_nodes(cells: DataFrame, asked: DataFrame) -> DataFrame:
    """The nodes of the cells whose addresses `sheet/<sheet>/cell/<ref>` stand in asked(path): what each shows, and its formula.

    Addresses of other kinds, and cells that are not there, give no row; references compare without case."""
    pattern = r"^sheet/(.+)/cell/([A-Za-z]{1,3}[0-9]+)$"
    wanted = asked.select(F.regexp_extract("path", pattern, 1).alias("_sheet"), F.upper(F.regexp_extract("path", pattern, 2)).alias("_ref")).filter("_ref <> ''").distinct()
    said, root = shown(), F.concat(F.lit("sheet/"), F.col("_sheet"))
    text = F.when(F.col("f").isNotNull(), F.concat(F.lit("`"), F.col("f"), F.lit("` → "), F.coalesce(said, F.lit("")))).when(F.coalesce(said, F.lit("")) == "", F.lit("(빈 값)")).otherwise(said)
    here = cells.join(wanted, (F.col("sheet_id").cast("string") == F.col("_sheet")) & (F.upper("ref") == F.col("_ref")))
    return here.select(*node(F.concat(root, F.lit("/cell/"), F.col("_ref")), root, 1, 0, "cell", F.col("_ref"), text, F.coalesce(said, F.lit("")), root)).withColumn("child_count", F.lit(0).cast("bigint"))


def resolve(nodes: DataFrame, path: str, depth: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """An address with its children to a depth and `found`, true.

    A last step `#n` is the n-th child by order; `.../cell/B4` is a single cell of `cells`.  An unknown
    address gives one row that holds nothing but the path and `found`, false."""
    if match := re.fullmatch(r"(.*)/#(\d+)", path):
        ranked = nodes.filter(F.col("parent_path") == match[1]).withColumn("_n", F.row_number().over(Window.partitionBy("parent_path").orderBy("ord"))).filter(F.col("_n") == int(match[2]))
        hit = ranked.drop("_n").withColumn("below", F.lit(0))
    elif cells is not None and re.fullmatch(r"sheet/.+/cell/[A-Za-z]{1,3}[0-9]+", path):
        hit = cell_nodes(cells, nodes.sparkSession.createDataFrame([(path,)], "path string")).withColumn("below", F.lit(0))
    else:
        hit = subtree(nodes, path, depth)
    asked = nodes.sparkSession.createDataFrame([(path,)], "asked string")
    out = asked.join(hit.withColumn("found", F.lit(True)), F.lit(True), "left")  # one row on the left
    return out.withColumn("path", F.coalesce("path", "asked")).withColumn("found", F.coalesce("found", F.lit(False))).select(*hit.columns, "found")


def map_lines(nodes: DataFrame, cap: int = MAP_NODES) -> DataFrame:
    """Per source: indented `- path — summary` lines in tree order, at most `cap` of them."""
    w = Window.partitionBy("source").orderBy("order_key", "path")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("path"), F.lit(" — "), F.coalesce("summary", F.lit("")))
    kept = nodes.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= cap)
    packed = kept.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("s"), F.count("*").alias("shown"))
    return packed.select("source", "shown", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("map"))


def verify(blocks: DataFrame, boxes: DataFrame | None = None, cells: DataFrame | None = None, width: float = 1280.0, height: float = 720.0, slides: DataFrame | None = None, sections: DataFrame | None = None, merges: DataFrame | None = None, names: DataFrame | None = None, charts: DataFrame | None = None) -> DataFrame:
    """Findings (path, level, message): the rules of blocks in one pass over them, those of boxes in another, one of each other table.

    Optional tables: boxes(slide_id, block_id, x, y, w, h), slides(slide_id), sections(doc_id), cells,
    merges(sheet_id, range) of sheets or (doc_id, pos, range) of a document's tables, names(sheet_id, name, target)
    and charts(sheet_id, chart_id, range)."""
    finding = lambda level, message: [F.lit(level).alias("level"), (message if isinstance(message, Column) else F.lit(message)).alias("message")]
    at = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("/b/"), F.col("pos").cast("string")).alias("path")
    # all rules of a block in one pass: what each finds goes into an array
    mine, level = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1), heading_level(F.col("md"))
    marked = blocks.withColumn("level", level).withColumn("previous", F.last(F.when(F.col("level") > 0, F.col("level")), ignorenulls=True).over(mine)).withColumn("s", F.when(F.col("block_type") == "table", table_shape(F.col("md"))))
    chart = F.regexp_extract("md", r"(?s)^```chart[^\n]*\n(.*?)\n?```", 1)
    rules = [
        ((F.col("level") > 0) & (F.col("level") > F.col("previous") + 1), "warn", F.concat(F.lit("heading skips from "), F.col("previous").cast("string"), F.lit(" to "), F.col("level").cast("string"))),
        (F.col("s.rows") < 1, "warn", F.lit("empty table")),
        (~F.col("s.header"), "info", F.lit("table without a header rule")),
        ((F.col("block_type") == "table") & (F.regexp_count("md", F.lit(r"(?m)^[ \t]*\|")) < 2), "error", F.lit("unreadable table")),
        (F.col("md").rlike(r"^```chart") & F.try_parse_json(chart).isNull(), "error", F.lit("unreadable chart")),
    ]
    hits = F.filter(F.array(*[F.when(rule, F.struct(F.lit(level).alias("level"), message.alias("message"))) for rule, level, message in rules]), lambda x: x.isNotNull())
    found = [marked.select(at, F.explode(hits).alias("h")).select("path", "h.level", "h.message")]
    if sections is not None:
        there = blocks.select("doc_id").distinct()
        found.append(sections.join(there, "doc_id", "left_anti").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), *finding("warn", "empty section")))
    if boxes is not None:
        path = F.concat(F.lit("slide/"), F.col("slide_id").cast("string"), F.lit("/"), F.col("block_id").cast("string")).alias("path")
        off = (F.col("x") >= width) | (F.col("y") >= height) | (F.col("x") + F.col("w") <= 0) | (F.col("y") + F.col("h") <= 0)
        hits = F.filter(F.array(F.when(off, F.lit("off the canvas")), F.when((F.col("w") <= 0) | (F.col("h") <= 0), F.lit("no size"))), lambda x: x.isNotNull())
        found.append(boxes.select(path, F.explode(hits).alias("hit")).select("path", *finding("warn", F.col("hit"))))
        if slides is not None:
            empty = slides.join(boxes.select("slide_id").distinct(), "slide_id", "left_anti")
            found.append(empty.select(F.concat(F.lit("slide/"), F.col("slide_id").cast("string")).alias("path"), *finding("warn", "empty slide")))
    if merges is not None:
        area = parse_area(F.col("range"))
        if "pos" in merges.columns:
            shaped = merges.join(marked.filter("block_type = 'table'").select("doc_id", "pos", "s"), ["doc_id", "pos"]).withColumn("a", area)
            outside = F.col("a").isNull() | (F.col("a.r1") > F.col("s.rows") + F.col("s.header").cast("int")) | (F.col("a.c1") > F.col("s.columns"))
            found.append(shaped.filter(outside).select(at, *finding("error", F.concat(F.lit("merge outside the table: "), F.coalesce("range", F.lit(""))))))
        else:
            bad = merges.withColumn("a", area).filter("a IS NULL OR (a.r0 = a.r1 AND a.c0 = a.c1)")
            found.append(bad.select(F.concat(F.lit("sheet/"), F.col("sheet_id").cast("string")).alias("path"), *finding("error", F.concat(F.lit("bad merge: "), F.coalesce("range", F.lit(""))))))
    if cells is not None:
        path = F.concat_ws("/", F.lit("sheet"), "sheet_id", F.lit("cell"), "ref").alias("path")
        found.append(cells.filter("t = 'e'").select(path, *finding("error", F.concat(F.lit("error cell "), F.coalesce("v_str", F.lit(""))))))
        full = cells.filter(filled()).select(F.col("sheet_id").cast("string").alias("_sheet")).distinct()
        if charts is not None:
            path = F.concat_ws("/", F.lit("sheet"), F.col("sheet_id").cast("string"), F.lit("chart"), F.col("chart_id").cast("string")).alias("path")
            found.append(charts.join(full, F.col("sheet_id").cast("string") == F.col("_sheet"), "left_anti").select(path, *finding("warn", "chart on an empty sheet")))
    if names is not None:
        path = F.concat_ws("/", F.lit("sheet"), F.col("sheet_id").cast("string"), F.lit("name"), "name").alias("path")
        bare = F.regexp_replace("target", r"^=?(?:'[^']+'|[^!']+)!|^=", "")
        found.append(names.filter(parse_area(bare).isNull()).select(path, *finding("error", F.concat(F.lit("bad target: "), F.coalesce("target", F.lit(""))))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def corpus_stats(blocks: DataFrame, by: Sequence[str], slides: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Blocks, words, characters that are no blanks, headings, and blocks by type.

    With slides (by, note): slides and those with a note; with cells (by, f): filled cells and formulas."""
    kinds = ("heading", "paragraph", "list", "table", "quote", "code", "image", "hr")
    out = blocks.groupBy(*by).agg(
        F.count("*").alias("blocks"), F.sum(count_words(F.col("md"))).alias("words"), F.sum(F.length(F.regexp_replace("md", r"\s", ""))).alias("characters"),
        *[F.count_if(F.col("block_type") == k).alias(f"n_{k}") for k in kinds],
    )
    if slides is not None:
        noted = F.count_if(F.trim(F.coalesce("note", F.lit(""))) != "")
        out = join_alike(out, slides.groupBy(*by).agg(F.count("*").alias("slides"), noted.alias("noted_slides")), by, "full_outer")
    if cells is not None:
        out = join_alike(out, cells.groupBy(*by).agg(F.count_if(filled()).alias("cells"), F.count("f").alias("formulas")), by, "full_outer")
    return out.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c not in by])


def digest(nodes: DataFrame, blocks: DataFrame, findings: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """One retrieval text per document: title, map, body in order, statistics, findings."""
    root = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    body = blocks.groupBy(root.alias("source")).agg(F.array_sort(F.collect_list(F.struct("pos", "md"))).alias("s")).select("source", F.array_join(F.transform("s", lambda x: x["md"]), "\n\n").alias("body"))
    stats = corpus_stats(blocks.withColumn("source", root), ["source"]).select("source", F.format_string("blocks %d, words %d, characters %d, headings %d", "blocks", "words", "characters", "n_heading").alias("stats"))
    sections = [("map", map_lines(nodes).select("source", F.col("map").alias("text"))), ("body", body.select("source", F.col("body").alias("text"))), ("statistics", stats.select("source", F.col("stats").alias("text")))]
    return joined_sections(nodes, sections, findings, cap)


def joined_sections(nodes: DataFrame, sections: Sequence[tuple[str, DataFrame]], findings: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """source, digest: a title and the sections (name, (source, text)) of each root node in their order, findings last; a section without text is left out."""
    out = nodes.filter("depth = 0").select("source", F.coalesce("title", F.col("source")).alias("title"))
    parts = [F.concat(F.lit("# "), F.col("title"))]
    if findings is not None:
        mine = findings.withColumn("source", F.substring_index("path", "/", 2)).withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("path", "message"))).filter(F.col("_n") <= cap)
        sections = [*sections, ("findings", mine.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "path", "message"))), "\n").alias("text")))]
    for k, (name, texts) in enumerate(sections):
        out = out.join(texts.select("source", F.col("text").alias(f"_s{k}")), "source", "left")
        parts.append(F.concat(F.lit(f"## {name}\n"), F.col(f"_s{k}")))
    return out.select("source", F.concat_ws("\n\n", *parts).alias("digest"))


#: What a digest calls the kinds of blocks, and a block or slide that holds nothing.
KIND_LABELS = {"text": "텍스트", "image": "이미지", "shape": "도형", "table": "표", "chart": "차트"}
EMPTY_BLOCK, EMPTY_SLIDE = "_(빈 요소)_", "_빈 슬라이드_"


def slide_digest(slides: DataFrame, blocks: DataFrame, findings: DataFrame | None = None, cap: int = 50, width: float = 1280.0, height: float = 720.0, tolerance: float = 40.0) -> DataFrame:
    """One retrieval text per slide: title, map, blocks in reading order, statistics, findings.

    slides(slide_id, title, layout, notes), blocks(slide_id, block_id, pos, kind, md, x, y, w, h, group array<string>) and, if
    there are shapes or charts, `shape` (its label) and `content` (a chart's description and table).  A block
    says its kind, where it stands in words and what it holds; the layout, the number of blocks and the notes
    stand above them."""
    root = F.concat(F.lit("slide/"), F.col("slide_id").cast("string"))
    nodes = slide_nodes(slides, blocks)
    ordered = reading_order(blocks, "slide_id", "block_id", tolerance).select(F.col("slide_id").alias("_s"), F.col("block_id").alias("_b"), "place")
    placed = blocks.join(ordered, F.col("slide_id").eqNullSafe(F.col("_s")) & F.col("block_id").eqNullSafe(F.col("_b"))).drop("_s", "_b")
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair]), F.col("kind")), F.col("kind"))
    label = F.when((F.col("kind") == "shape") & F.col("shape").isNotNull(), F.concat(label, F.lit("("), F.col("shape"), F.lit(")"))).otherwise(label) if "shape" in blocks.columns else label
    said = F.trim(F.coalesce("md", F.lit("")))
    said = F.coalesce(F.col("content"), said) if "content" in blocks.columns else said
    where = position_phrase(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height)
    text = F.concat(F.lit("### "), (F.col("place") + 1).cast("string"), F.lit(") "), F.concat_ws(" — ", label, where), F.lit("\n\n"), F.when(said == "", F.lit(EMPTY_BLOCK)).otherwise(said))
    body = placed.groupBy(root.alias("source")).agg(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))).alias("s"), F.count("*").alias("n"), F.sum(count_words(F.col("md"))).alias("words"))
    heads = slides.select(root.alias("source"), "layout", F.trim(F.regexp_replace(F.coalesce("notes", F.lit("")), r"\s+", " ")).alias("notes")).join(body, "source", "left")
    about = F.concat_ws("\n", F.concat(F.lit("- layout: "), F.col("layout")), F.concat(F.lit("- blocks: "), F.coalesce("n", F.lit(0)).cast("string")), F.when(F.col("notes") != "", F.concat(F.lit("- notes: "), F.col("notes"))))
    whole = F.concat(about, F.lit("\n\n"), F.coalesce(F.array_join(F.transform("s", lambda x: x["t"]), "\n\n"), F.lit(EMPTY_SLIDE)))
    stats = heads.select("source", F.format_string("blocks %d, words %d, notes %d", F.coalesce("n", F.lit(0)), F.coalesce("words", F.lit(0)), (F.col("notes") != "").cast("int")).alias("text"))
    sections = [("map", map_lines(nodes).select("source", F.col("map").alias("text"))), ("slide", heads.select("source", whole.alias("text"))), ("statistics", stats)]
    return joined_sections(nodes, sections, findings, cap)


def sheet_digest(cells: DataFrame, sheets: DataFrame, names: DataFrame | None = None, charts: DataFrame | None = None, findings: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """One retrieval text per sheet: title, map, column profile, records, formulas, charts, names, statistics, findings."""
    nodes = sheet_nodes(cells, sheets, names, charts)
    root = F.concat(F.lit("sheet/"), F.col("sheet_id").cast("string")).alias("source")

    def lines(df: DataFrame, order: Column, line: Column) -> DataFrame:
        packed = df.groupBy(root).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("s"))
        return packed.select("source", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("text"))

    figure = lambda c: F.concat(F.lit(f"{c} "), F.col(c).cast("string"))
    profile = lines(column_profile(cells, sheets), F.col("col"), F.concat(F.lit("- "), F.coalesce("header", column_name(F.col("col"))), F.lit(": "), F.concat_ws(", ", "type", figure("filled"), figure("total"), figure("average"))))
    rows = lines(records(cells, sheets), F.col("row"), F.col("record"))
    formulas = lines(cells.filter(F.col("f").isNotNull()), F.struct("row", "col"), F.concat(F.lit("- "), F.col("ref"), F.lit(" "), F.col("f")))
    counted = cells.groupBy(root).agg(F.count_if(filled()).alias("n"), F.count("f").alias("f")).select("source", F.format_string("cells %d, formulas %d", "n", "f").alias("text"))
    sections = [("map", map_lines(nodes).select("source", F.col("map").alias("text"))), ("profile", profile), ("records", rows), ("formulas", formulas)]
    if charts is not None:
        sections.append(("charts", lines(charts, F.col("chart_id").cast("string"), F.concat_ws(" ", F.lit("-"), "title", "range"))))
    if names is not None:
        sections.append(("names", lines(names, F.col("name"), F.concat_ws(" ", F.lit("-"), "name", "target"))))
    return joined_sections(nodes, [*sections, ("statistics", counted)], findings, cap)
