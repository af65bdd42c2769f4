"""The filter interaction audit against brute force over all orders."""

import collections
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridloom.llm import interactions

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(250))
TEXTS = [None, "", "short", LONG, LONG, LONG.upper(), "same word " * 150, "same word " * 150, LONG + " $5", "A B", "é" * 99 + "AA", "tab\tand\x0bfeed\x0c\r\n" * 60, "　wide　", LONG * 400]


def brute(rows, labels):
    """Counts by (part, order, step), straight from the definitions."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(smallest.get(text or "", i), i)
    docs = collections.defaultdict(list)
    for i, text, source in rows:
        t = text or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        fails = {x for x, failed in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and smallest[t] < i,
        }.items() if failed}
        docs[source or ""].append((i, fails))
    out = {}
    for part, members in docs.items():
        shapley = collections.Counter()
        for order in permutations("ABCDE"):
            left = members
            for k, letter in enumerate(order):
                removed = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = [d for d in members if letter in d[1]]
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(failing) - len(removed), sum(d[1] == {letter} for d in members), sum(d[0] in good for d in removed), sum(d[0] in toxic for d in removed)]
                shapley[letter] += len(removed)
        for (p, order, k), row in out.items():
            if p == part:
                row.append(shapley[order[k - 1]])
    return out


def test_audit(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(TEXTS)]
    rows += [(30, LONG, "s1"), (30, LONG, "s2"), (3, LONG, "s0"), (None, LONG, "s0"), (None, LONG, None), (31, "unlike", "s0"), (31, "unlike", "s0"), (None, "no other", "s2")]
    labels = [(3, 1, 0), (3, 0, 1), (4, None, 1), (30, 1, None), (31, 1, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS).select("*", F.lit(1).alias("mask"), F.lit("x").alias("digest"), F.lit(2).alias("part"), F.lit(3).alias("a.b"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(5))
    made = interactions.audit(interactions.mask_cells(docs, marks)).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in made}
    assert len(made) == len(got) == 4 * 600 and got == brute(rows, labels)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(interactions.mask_cells(docs, labels)).count() == 0
    one = interactions.audit(interactions.mask_cells(spark.createDataFrame([(1, LONG, "en", "s", 1)], DOCS), labels))
    assert one.count() == 600 and one.filter("kept <> 1 OR removed + redundant + good_lost + toxic_lost + shapley <> 0").count() == 0


def test_letters(spark):
    cells = spark.createDataFrame([("p", 0, 3, 1, 0), ("p", 3, 2, 0, 1)], "part string, mask int, n long, n_good long, n_toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in interactions.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (3, 2, 0, 2), ("XY", 2): (3, 0, 2, 2), ("YX", 1): (3, 2, 0, 2), ("YX", 2): (3, 0, 2, 2)}
    assert interactions.steps(spark, "ABCDE").count() == 10_400
    for wrong in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            interactions.steps(spark, wrong)


def test_one_scan_of_texts(spark):
    """Texts are read once and never shuffled."""
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = interactions.mask_cells(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
