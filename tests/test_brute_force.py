"""Queries that SQL cannot say, against plain Python over the same tables, and operators on small fixtures."""

import json
from collections import Counter, defaultdict

import regex
from conftest import SF
from pyspark.sql import functions as F

from gridloom.operators import cells as K
from gridloom.operators import charts as C
from gridloom.operators import documents as D
from gridloom.plans import catalogue

QUERIES = catalogue.queries()


def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def plain(md):
    for pattern, new in D.PLAIN_REWRITES:
        md = regex.sub(pattern, new.replace("$1", r"\1"), md)
    return md


def words(md):
    t = plain(md)
    return len(regex.findall(r"[ᄀ-ᇿ　-ヿ㄰-㆏一-鿿가-힣]", t)) + len(regex.findall(r"[A-Za-z0-9'’-]+", t))


def test_corpus_statistics(spark):
    want = defaultdict(Counter)
    for r in texts(spark).values():
        for kind, md in D.split_markdown(r.text):
            want[r.source].update({"blocks": 1, "words": words(md), "characters": len(regex.sub(r"[ \t\n\x0B\f\r]", "", md)), f"n_{kind}": 1})
    got = QUERIES["corpus_statistics"](spark, SF).collect()
    assert {r.source for r in got} == set(want)
    for r in got:
        assert all(r[c] == want[r.source][c] for c in got[0].asDict() if c != "source")


def plain_findings(doc_id, text):
    before = None
    for pos, (kind, md) in enumerate(D.split_markdown(text)):
        path = f"doc/{doc_id}/b/{pos}"
        if level := len((regex.match(r"(#{1,6})[ \t]+", md.strip(" ")) or [""])[0].strip(" \t")):
            if before and level > before + 1:
                yield path, f"heading skips from {before} to {level}"
            before = level
        if kind == "table":
            lines = [x for x in md.strip(" ").split("\n") if "|" in x]
            rule = any(regex.match(r"[ \t]*\|?[ \t:|-]*-[ \t:|-]*$", x) for x in lines)
            if len(lines) - (2 if rule else 0) < 1:
                yield path, "empty table"
            if not rule:
                yield path, "table without a header rule"
            if sum(bool(regex.match(r"[ \t]*\|", x)) for x in md.split("\n")) < 2:
                yield path, "unreadable table"
        if md.startswith("```chart"):
            found = regex.search(r"(?s)^```chart[^\n]*\n(.*?)\n?```", md)
            try:
                json.loads(found[1] if found else "")
            except ValueError:
                yield path, "unreadable chart"


def test_document_findings(spark):
    want = sorted(x for r in texts(spark).values() for x in plain_findings(r.doc_id, r.text))
    assert sorted((r.path, r.message) for r in QUERIES["document_findings"](spark, SF).collect()) == want


def test_maps_and_digests(spark):
    """Title, map lines in tree order, body, statistics and findings of every conversation."""
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append(r)
    got = {r.source: r.digest for r in QUERIES["maps_and_digests"](spark, SF).collect()}
    assert got.keys() == {f"doc/{c}" for c in turns}
    for conv, rows in turns.items():
        seen, asked, lines, body, skips, last = Counter(), False, [f"- doc/{conv} — conversation {conv}"], [], [], None
        for i, r in enumerate(rows):
            level = 1 if r.turn == 0 else 2 if r.role == "user" else 4
            depth = 1 if level == 1 else 3 if level == 4 and asked else 2
            asked = asked or level == 2
            seen[r.role] += 1
            path = f"doc/{conv}/h/{r.role}" + (f"-{seen[r.role]}" if seen[r.role] > 1 else "")
            quote = "\n".join("> " + x for x in r.text.split("\n"))
            lines += [f"{'  ' * depth}- {path} — {r.role}", f"{'  ' * (depth + 1)}- doc/{conv}/b/{2 * i + 1} — "]
            body += ["#" * level + " " + r.role, quote]
            if last and level > last + 1:
                skips.append(f"doc/{conv}/b/{2 * i}: heading skips from {last} to {level}")
            last = level
        text = got[f"doc/{conv}"]
        assert text.startswith(f"# conversation {conv}\n\n## map\n")
        shown = text.split("## map\n")[1].split("\n\n## body\n")[0].split("\n")
        assert len(shown) == len(lines) and all(a.startswith(b) for a, b in zip(shown, lines))
        assert "\n\n## body\n" + "\n\n".join(body) + "\n\n## statistics\n" in text
        assert f"blocks {len(body)}, words {sum(map(words, body))}," in text and f"headings {len(rows)}" in text
        assert sorted(text.split("## findings\n")[1].split("\n") if "## findings\n" in text else []) == sorted(skips)


def test_rules_on_fixtures(spark):
    """One breach of every structure rule, and none where all is well."""
    docs = spark.createDataFrame([(1, "# a\n\n### b\n\n| x | y |\n|---|---|\n| 1 | 2 |"), (2, "| only |"), (3, "```chart\n{bad\n```"), (4, "")], "doc_id long, text string")
    blocks = D.split_blocks(docs)
    boxes = spark.createDataFrame([(1, "in", 0.0, 0.0, 5.0, 5.0), (1, "off", 2000.0, 0.0, 5.0, 5.0), (1, "flat", 10.0, 0.0, 0.0, 5.0)], "slide_id long, block_id string, x double, y double, w double, h double")
    slides = spark.createDataFrame([(1,), (2,)], "slide_id long")
    inner = spark.createDataFrame([(1, 2, "A1:B2"), (1, 2, "A1:C2"), (1, 2, "zz")], "doc_id long, pos int, range string")
    cells = spark.createDataFrame([("s", 1, 1, "A1", "#N/A", "e")], "sheet_id string, row int, col int, ref string, v_str string, t string").select("*", F.lit(None).cast("double").alias("v_num"), F.lit(None).cast("boolean").alias("v_bool"))
    names = spark.createDataFrame([("s", "good", "=Sheet1!$A$1:$B$2"), ("s", "bad", "nowhere")], "sheet_id string, name string, target string")
    charts = spark.createDataFrame([("s", "c1", "A1:B2"), ("t", "c2", "A1:B2")], "sheet_id string, chart_id string, range string")
    found = D.verify(blocks, boxes, cells, slides=slides, sections=docs.select("doc_id"), merges=inner, names=names, charts=charts)
    assert {(r.path, r.message) for r in found.collect()} == {
        ("doc/1/b/1", "heading skips from 1 to 3"), ("doc/2/b/0", "table without a header rule"), ("doc/2/b/0", "unreadable table"), ("doc/3/b/0", "unreadable chart"), ("doc/4", "empty section"),
        ("slide/1/off", "off the canvas"), ("slide/1/flat", "no size"), ("slide/2", "empty slide"), ("doc/1/b/2", "merge outside the table: A1:C2"), ("doc/1/b/2", "merge outside the table: zz"),
        ("sheet/s/cell/A1", "error cell #N/A"), ("sheet/s/name/bad", "bad target: nowhere"), ("sheet/t/chart/c2", "chart on an empty sheet"),
    }
    areas = spark.createDataFrame([("s", "B2"), ("s", "A1:B1"), ("s", "x:y")], "sheet_id string, range string")
    assert sorted(r.message for r in D.verify(blocks.limit(0), merges=areas).collect()) == ["bad merge: B2", "bad merge: x:y"]


def grid(spark):
    rows = [(1, 1, "item", None, None), (1, 2, "sum", None, None), (2, 1, "a", None, None), (2, 2, None, 3.0, "=1+2"), (3, 1, "b", None, None), (3, 2, None, 4.0, None)]
    cells = spark.createDataFrame(rows, "row int, col int, v_str string, v_num double, f string").select(F.lit("p").alias("project_id"), F.lit("s").alias("sheet_id"), "*", F.concat(K.column_name(F.col("col")), F.col("row").cast("string")).alias("ref"), F.lit(None).cast("boolean").alias("v_bool"), F.when(F.col("v_num").isNotNull(), "n").otherwise("s").alias("t"), F.lit(None).cast("string").alias("fmt"), F.lit(None).cast("map<string,string>").alias("style"))
    return cells, spark.createDataFrame([("s", "Budget", 0)], "sheet_id string, name string, frozen_rows int")


def test_sheet_tree_and_digest(spark):
    cells, sheets = grid(spark)
    names = spark.createDataFrame([("s", "total", "=B2:B3")], "sheet_id string, name string, target string")
    charts = spark.createDataFrame([("s", "c1", "Sums", "A1:B3")], "sheet_id string, chart_id string, title string, range string")
    nodes = D.sheet_nodes(cells, sheets, names, charts)
    assert {(r.path, r.kind, r.depth, r.child_count) for r in nodes.collect()} == {
        ("sheet/s", "sheet", 0, 3), ("sheet/s/region/1", "region", 1, 2), ("sheet/s/region/1/column/A", "column", 2, 0), ("sheet/s/region/1/column/B", "column", 2, 0), ("sheet/s/name/total", "name", 1, 0), ("sheet/s/chart/c1", "chart", 1, 0),
    }
    one = D.resolve(nodes, "sheet/s/cell/b2", cells=cells).first()
    assert (one.path, one.kind, one.summary, one.found) == ("sheet/s/cell/B2", "cell", "`=1+2` → 3", True)
    assert [(r.path, r.kind, r.found) for r in D.resolve(nodes, "sheet/s/cell/Z9", cells=cells).collect()] == [("sheet/s/cell/Z9", None, False)]
    text = D.sheet_digest(cells, sheets, names, charts).first()["digest"]
    heads = [x[3:] for x in text.split("\n") if x.startswith("## ")]
    assert heads == ["map", "profile", "records", "formulas", "charts", "names", "statistics"]
    assert "- sum: number, filled 2, total 7.0, average 3.5" in text and "2행: item=a, sum=3" in text and "- B2 =1+2" in text and text.endswith("cells 6, formulas 1")


def test_slide_tree(spark):
    slides = spark.createDataFrame([(1, "One")], "slide_id long, title string")
    blocks = spark.createDataFrame([(1, "x", 0, "# head", None), (1, "y", 1, "in", ["g"]), (1, "z", 2, "deep", ["g", "h"])], "slide_id long, block_id string, pos int, md string, group array<string>")
    assert {(r.path, r.parent_path, r.depth, r.child_count) for r in D.slide_nodes(slides, blocks).collect()} == {
        ("slide/1", None, 0, 2), ("slide/1/block/x", "slide/1", 1, 0), ("slide/1/group/g", "slide/1", 1, 2), ("slide/1/block/y", "slide/1/group/g", 2, 0),
        ("slide/1/group/g/h", "slide/1/group/g", 2, 1), ("slide/1/block/z", "slide/1/group/g/h", 3, 0),
    }


def test_statistics_of_slides_and_cells(spark):
    cells, _ = grid(spark)
    blocks = spark.createDataFrame([("p", "paragraph", "two words")], "project_id string, block_type string, md string")
    slides = spark.createDataFrame([("p", "say this"), ("p", " "), ("q", None)], "project_id string, note string")
    got = {r.project_id: r for r in D.corpus_stats(blocks, ["project_id"], slides, cells).collect()}
    assert (got["p"].words, got["p"].slides, got["p"].noted_slides, got["p"].cells, got["p"].formulas) == (2, 2, 1, 6, 1) and (got["q"].blocks, got["q"].slides) == (0, 1)


def test_charts_keep_stored_numbers(spark):
    cells, _ = grid(spark)
    stored = "array(named_struct('name', 'old', 'values', array(9.0D)))"
    charts = spark.sql(f"SELECT * FROM (VALUES ('a', 's', 'A1:B3', array('x'), {stored}), ('b', 's', 'nowhere', array('x'), {stored}), ('c', 's', 'A1:A3', array('x'), {stored})) AS t(chart_id, sheet_id, range, labels, series)")
    got = sorted((r.chart_id, r.name, r.label, r.value) for r in C.charts_from_ranges(charts, cells).collect())
    assert got == [("a", "sum", "a", 3.0), ("a", "sum", "b", 4.0), ("b", "old", "x", 9.0), ("c", "old", "x", 9.0)]


def test_region_blocks(spark):
    docs = spark.createDataFrame([(1, "intro\n<!-- block:x | w=2 -->\n# head\n\ntext\n<!-- block:x -->\nlast")], "doc_id long, text string")
    got = [(r.pos, r.region, r.block_id, r.options, r.md) for r in D.region_blocks(D.anchored_regions(docs)).orderBy("pos").collect()]
    assert got == [(0, 0, None, None, "intro"), (1, 1, "x", {"w": "2"}, "# head"), (2, 1, None, None, "text"), (3, 2, "x-2", None, "last")]
