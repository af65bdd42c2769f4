"""Trees, rectangles, order statistics of large groups, missing keys and patterns on small fixtures, with adaptive plans off."""

import random
from collections import defaultdict
from statistics import mean

import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridloom.functions.lineage import pinned
from gridloom.operators import aggregates as A
from gridloom.operators import documents as D
from gridloom.operators import lookups as J
from gridloom.operators import orderstats as Q
from gridloom.plans import catalogue


@pytest.fixture
def fixed(spark):
    """Range partitions as they are laid out, not put together again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wide_sheet(spark):
    """Eleven regions of 30 columns and two names."""
    rows = [("p", "s", 3 * r + k, c, f"h{c}" if k == 0 else None, float(r) if k else None, "s" if k == 0 else "n") for r in range(1, 12) for c in range(1, 31) for k in (0, 1)]
    cells = spark.createDataFrame(rows, "project_id string, sheet_id string, row int, col int, v_str string, v_num double, t string")
    blank = lambda kind: F.lit(None).cast(kind)
    cells = cells.withColumns({"f": blank("string"), "v_bool": blank("boolean"), "fmt": blank("string"), "style": blank("map<string,string>"), "ref": blank("string")})
    sheets = spark.createDataFrame([("s", "Sheet")], "sheet_id string, name string")
    names = spark.createDataFrame([("s", "zz", "A1"), ("s", "aa", "B2")], "sheet_id string, name string, target string")
    return D.sheet_nodes(cells, sheets, names)


def test_tree_order_and_intervals(fixed):
    nodes = wide_sheet(fixed)
    lines = [x.strip().split(" ")[1] for x in D.map_lines(nodes).first()["map"].split("\n")]
    letters = [chr(65 + c) if c < 26 else "A" + chr(39 + c) for c in range(30)]
    want = ["sheet/s"] + [p for r in range(1, 12) for p in (f"sheet/s/region/{r}", *(f"sheet/s/region/{r}/column/{x}" for x in letters))] + ["sheet/s/name/aa", "sheet/s/name/zz"]
    assert lines == want
    assert len(D.map_lines(nodes, 40).first()["map"].split("\n")) == 40
    kept = pinned(D.with_intervals(nodes))
    at = {r.path: (r.low, r.high) for r in kept.collect()}
    assert [at[p][0] for p in want] == list(range(1, len(want) + 1))
    assert at["sheet/s"] == (1, len(want)) and at["sheet/s/region/11"][1] - at["sheet/s/region/11"][0] == 30
    below = D.subtree(kept, "sheet/s/region/10")
    assert {r.path for r in below.collect()} == {p for p in want if p.startswith("sheet/s/region/10")}
    assert D.subtree(kept, "sheet/s", 1).count() == 14 and D.subtree(kept, "none").count() == 0
    assert "Join" not in plan(below)  # a range filter, no join a level


def test_subtree_of_nested_headings(fixed):
    text = "# A\n\nx\n\n## B\n\ny\n\n#### C\n\nz\n\n## D\n\n# E\n\n### F\n\nw"
    docs = fixed.createDataFrame([(1, text), (2, "# A\n\nq"), (None, "r")], "doc_id long, text string")
    nodes = D.build_nodes(docs.select("doc_id", F.lit("t").alias("title")), D.split_blocks(docs)).cache()
    children = defaultdict(set)
    for r in nodes.collect():
        children[r.parent_path].add(r.path)

    def walk(path, depth):
        return {path} | {p for c in children[path] if depth for p in walk(c, depth - 1)}

    for path in ("doc/1", "doc/1/h/a", "doc/1/h/b", "doc/1/h/e", "doc/2"):
        for depth in (0, 1, 2, 6):
            assert {r.path for r in D.subtree(nodes, path, depth).collect()} == walk(path, depth)


def test_labels(spark):
    pairs = {
        "1. First step": "1. First step", "snake_case": "snakecase", "text\n## Head *it*\nmore": "Head it", "- a\n- b": "a", "* a": "a", "> q": "q",
        "![alt](x.png) [link](y)": "alt link", "   ": "", "`code` #tag": "code tag", "x" * 61: "x" * 59 + "…", "x" * 60: "x" * 60, None: "",
    }
    rows = spark.createDataFrame([(m,) for m in pairs], "md string").select("md", D.block_label(F.col("md"), 60).alias("l")).collect()
    assert {r.md: r.l for r in rows} == pairs


def test_rules_in_one_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(D.verify(D.split_blocks(docs)))
    assert text.count("ArrowEvalPython") == 1 and text.count("FileScan") == 1 and "Union" not in text


def test_reading_order_of_a_large_slide(spark):
    """100,000 blocks of one slide, in a stream and not in an array."""
    blocks = spark.range(100_000).select(F.when(F.col("id") < 5, None).otherwise(1).alias("s"), F.col("id").alias("b"), (F.col("id") * 7 % 1000).cast("double").alias("x"), F.when(F.col("id") > 10, F.col("id") * 13 % 5000).alias("y"))
    rows = D.reading_order(blocks, "s", "b").filter("s = 1").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(99_995))
    ys = sorted({i * 13 % 5000 for i in range(11, 100_000)})
    top, band, bands = ys[0], 0, {}
    for y in ys:
        if y > top + 40:
            top, band = y, band + 1
        bands[y] = band
    assert all(r.band == bands[r.b * 13 % 5000] for r in rows if r.b > 10) and all(r.band == 0 for r in rows if r.b <= 10)


def test_slide_digest(spark):
    none = "array()"
    blocks = spark.createDataFrame([(1, "b", 0, "text", "# Hi", 0.0, 300.0, 1280.0, 50.0, None, None), (1, "a", 1, "shape", " ", 0.0, 0.0, 100.0, 50.0, "판단", None), (1, "c", 2, "chart", "```chart\n{}\n```", 900.0, 650.0, 300.0, 50.0, None, "a chart")], "slide_id int, block_id string, pos int, kind string, md string, x double, y double, w double, h double, shape string, content string").withColumn("group", F.expr(none).cast("array<string>"))
    slides = spark.createDataFrame([(1, "One", "two-column", "say\n this"), (2, None, None, None)], "slide_id int, title string, layout string, notes string")
    found = spark.createDataFrame([("slide/1/a", "warn", "no size")], "path string, level string, message string")
    got = {r.source: r.digest for r in D.slide_digest(slides, blocks, found).collect()}
    order = [got["slide/1"].index(x) for x in ("# One", "## map", "- layout: two-column", "- blocks: 3", "- notes: say this", "### 1) 도형(판단) — 상단 좌측, 좁은 폭\n\n_(빈 요소)_", "### 2) 텍스트 — 정중앙, 전체 폭\n\n# Hi", "### 3) 차트 — 하단 우측, 좁은 폭\n\na chart", "## statistics", "## findings\nslide/1/a: no size")]
    assert order == sorted(order) and "_빈 슬라이드_" in got["slide/2"] and got["slide/2"].startswith("# slide/2")


def test_areas(fixed):
    random.seed(2)
    areas = [(random.choice("st"), random.randint(1, 3000), random.randint(1, 60), random.randint(1, 3000), random.randint(1, 60), i) for i in range(60)] + [("s", 1, 1, 1_048_576, 16_384, 900), ("u", 1, 1, 5, 5, 901)]
    cells = sorted({(random.choice("st"), random.randint(1, 3000), random.randint(1, 60)) for _ in range(400)}) + [("s", 1_048_576, 16_384)]
    met = J.in_areas(fixed.createDataFrame(areas, "k string, r0 int, c0 int, r1 int, c1 int, n int"), fixed.createDataFrame(cells, "k string, row int, col int"), ["k"])
    want = sorted((n, k, r, c) for k0, a, b, x, y, n in areas for k, r, c in cells if k == k0 and min(a, x) <= r <= max(a, x) and min(b, y) <= c <= max(b, y))
    assert sorted((r.n, r.k, r.row, r.col) for r in met.collect()) == want
    assert "CartesianProduct" not in plan(met) and "BroadcastNestedLoopJoin" not in plan(met)


def test_order_statistics(fixed):
    random.seed(4)
    rows = [(random.choice([None, "p", "q"]), random.choice([None, *range(-20, 20)])) for _ in range(700)] + [("one", 5), ("none", None)]
    df = fixed.createDataFrame(rows, "k string, x int").repartition(5)
    groups = defaultdict(list)
    for k, x in rows:
        groups[k] += [] if x is None else [x]
    exact = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(*[A.percentile(F.col("x"), p) for p in (0, 0.13, 0.5, 1)]).collect() if r.k != "none"}
    made = {r.k: tuple(r)[1:] for r in Q.quantiles(df, "x", {"a": 0, "b": 0.13, "c": 0.5, "d": 1}, ["k"]).collect()}
    assert set(made) == set(exact) and all(made[k] == pytest.approx(exact[k]) for k in exact)
    assert Q.quantiles(df, "x", {"a": 1.5}, ["k"]).filter("a IS NOT NULL").count() == 0
    for k in (1, 7, 200, 100_000):
        for largest in (True, False):
            want = {g: sorted(v, reverse=largest)[k - 1] for g, v in groups.items() if len(v) >= k}
            assert {r.k: r.x for r in Q.kth(df, "x", k, ["k"], largest).collect()} == want
    cut = lambda v, s: sorted(v)[int(len(v) * s / 2) : len(v) - int(len(v) * s / 2)]
    for share in (0.0, 0.2, 0.99):
        got = {r.k: r.trimmean for r in A.trimmean(df, "x", share, ["k"]).collect()}
        assert got == pytest.approx({g: mean(cut(v, share)) for g, v in groups.items() if v})
    assert Q.quantiles(df, "x", {"m": 0.5}).first()["m"] == df.agg(F.median("x")).first()[0] and Q.kth(df.limit(0), "x", 1).count() == 0


def test_a_group_is_cut_into_ranges(spark):
    """One group of 20,000 distinct values lies in several tasks."""
    df = spark.range(20_000).select(F.lit("g").alias("k"), F.col("id").alias("x"))
    text = plan(Q.quantiles(df, "x", {"m": 0.5}, ["k"]))
    assert "percentile" not in text and "collect" not in text
    assert Q.quantiles(df, "x", {"m": 0.5}, ["k"]).first()["m"] == 9_999.5
    assert "rangepartitioning" in plan(df.repartitionByRange("k", "x"))


def test_gcd_and_lcm_in_parts(fixed):
    rows = [("a", 12.0), ("a", 18.9), ("zero", 0.0), ("zero", 4.0), ("neg", -1.0), ("neg", 4.0), ("none", None), (None, 6.0), (None, 10.0), ("big", 2.0**61), ("big", 3.0**30)]
    got = {r.k: (r.gcd, r.lcm) for r in A.gcd_lcm_of(fixed.createDataFrame(rows, "k string, x double").repartition(4), "x", ["k"]).collect()}
    assert got == {"a": (6, 36), "zero": (4, 0), "neg": (None, None), "none": (0, 0), None: (2, 30), "big": (1, None)}
    assert tuple(A.gcd_lcm_of(fixed.createDataFrame([], "x double"), "x").first()) == (0, 0)
    hot = fixed.range(0, 300_000, 1, 8).select(((F.col("id") + 1) * 14).alias("x"))
    assert tuple(A.gcd_lcm_of(hot, "x").first()) == (14, None)


def test_missing_keys(fixed):
    left = fixed.range(399).select(F.lit(None).cast("string").alias("g"), F.col("id").alias("k"))
    right = fixed.createDataFrame([(None, -1, 7), ("x", 5, 1)], "g string, k long, v int")
    assert [tuple(r) for r in J.nearest(left, "k", right, "k", "v", "v", "below", ["g"]).groupBy("v").count().collect()] == [(7, 399)]
    before = fixed.createDataFrame([(None, 1, 5), ("x", None, 6), ("y", 1, 1), (None, 2, 2)], "a string, b int, v int")
    after = fixed.createDataFrame([(None, 1, 5), ("x", None, 7), (None, 3, 3), (None, 2, None)], "a string, b int, v int")
    assert {(r.a, r.b, r.change) for r in J.diff_rows(before, after, ["a", "b"], ["v"]).collect()} == {("x", None, "changed"), ("y", 1, "removed"), (None, 3, "added"), (None, 2, "changed")}
    ties = fixed.createDataFrame([("k", 1, "b"), ("K", 1, "a"), ("k", 2, "c"), ("k", 2, "d")], "t string, o int, v string")
    asked = fixed.createDataFrame([("k",)], "t string")
    assert [J.xlookup(asked, "t", ties, "t", "v", "o", "hit", last=last).first()["hit"] for last in (False, True)] == ["a", "d"]


def test_wildcards(fixed):
    patterns = ["ab*z", "*foo*", "?x*", "(a)+*", "*NOPE*", None, "*", "abc", "l*oo", "A?C*F??", "[x].{2}"]
    texts = ["abcz", "ABz", "a foo b", "xx", "axb", "(A)+q", None, "line\nfoo", "abc", "ABC", "abcdefgh", "[x].{2}", ""]
    import re

    fits = lambda p, t: p is not None and t is not None and re.fullmatch(re.escape(p).replace(r"\*", ".*").replace(r"\?", "."), t, re.I | re.S) is not None
    asked = fixed.createDataFrame([(p,) for p in patterns], "p string")
    table = fixed.createDataFrame(list(enumerate(texts)), "o int, t string")
    for last in (False, True):
        got = {r.p: r.hit for r in J.xlookup(asked, "p", table, "t", "o", "o", "hit", 2, last=last).collect()}
        assert got == {p: (max if last else min)((i for i, t in enumerate(texts) if fits(p, t)), default=None) for p in patterns}
    literal = asked.filter("p IN ('*foo*', 'ab*zzz')")
    text = plan(J.wildcard_pairs(literal, "p", table, "t"))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_no_query_twice():
    """New structures have queries with SQL."""
    assert {"sheet_intervals", "slide_digests", "edges_by_tiles", "streamed_updates", "streamed_versions"} <= set(catalogue.oracle_sql())


def test_wildcards_of_many_copies(fixed):
    """Patterns with a common piece meet texts by their whole run and their ending, copies once; no table of pieces is broadcast."""
    texts = fixed.range(6_000).select(F.col("id").alias("o"), F.format_string("Customer#%09d", F.col("id") % 3_000).alias("t"))
    texts = texts.unionByName(fixed.createDataFrame([(-1, "Customer#000000001\n")], "o long, t string"))  # ends in a line feed, not in 01
    asked = fixed.createDataFrame([(f"*stomer#0000000*{i:02}",) for i in range(100)] + [("*STOMER#00000?999",), ("stomer*01",), ("*01\n",)], "p string")
    pairs = J.wildcard_pairs(asked, "p", texts, "t")
    tree = plan(pairs)
    assert "BroadcastNestedLoopJoin" not in tree and "CartesianProduct" not in tree
    got = {r["_key"]: r["n"] for r in pairs.groupBy("_key").agg(F.count("*").alias("n")).collect()}
    assert got == {**{f"*stomer#0000000*{i:02}": 2 for i in range(100)}, "*STOMER#00000?999": 6, "*01\n": 1}
    lines = tree.split("\n")
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
            below = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            assert not any("Generate explode(array_distinct" in x for x in lines[i:below])


def test_cells_find_their_region_by_row(spark):
    """The rows of find_regions' bands, one region a row; no join of a sheet's cells with all its regions."""
    from gridloom.operators import cells as K
    from gridloom.plans.sheet import part_cells

    cells = part_cells(spark, SF)
    bands = {(r.sheet_id, n): (r.region, r.r0) for r in K.find_regions(cells).collect() for n in range(r.r0, r.r1 + 1)}
    assert {(r.sheet_id, r.row): (r.region, r.r0) for r in K.region_rows(cells).collect()} == bands
    plan = K.region_profile(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "row#" in plan and not [x for x in plan.splitlines() if "Join" in x and ">= r0" in x]
