"""Toxicity against a plain restatement: all words, idf, emphasis, neighbours, votes and scores."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridloom.llm import queries, shared, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "word " * 30_000, "x" * 50_000, "ÀÉ ñandú 漢字 🙂 <|endoftext|>", "12 34 !!", "same text here for all", "same text here for all"]


def plain_words(text):
    return "".join(c.lower() if c.isascii() else c for c in "".join(c if c > "\x7f" or c.isalpha() else " " for c in text or "")).encode().replace(b"\t", b" ").split(b" ")


def plain_model(rows):
    """Vectors (dicts) of (id, label, text) rows by the stated rules, and the weight of each word."""
    bags = {i: Counter(w for w in plain_words(t) if w) for i, _, t in rows}
    groups = {i: min((zlib.crc32(b" ".join(ws[k : k + 5])) for k in range(max(1, len(ws) - 4))), default=0) for i, ws in ((i, [w for w in plain_words(t) if w]) for i, _, t in rows)}
    df, a = defaultdict(set), defaultdict(set)
    for i, y, _ in rows:
        for w in bags[i]:
            df[w].add(groups[i])
            if y:
                a[w].add(groups[i])
    n, n1 = len(set(groups.values())), len({groups[i] for i, y, _ in rows if y})
    weight = {}
    for w, d in df.items():
        x = len(a[w])
        b = min(len(d) - x, n - n1)
        odds = math.log((x + 0.5) / (n1 - x + 0.5)) - math.log((b + 0.5) / (n - n1 - b + 0.5))
        z = odds / math.sqrt(1 / (x + 0.5) + 1 / (b + 0.5))
        weight[w] = (math.log((1 + n) / (1 + len(d))) + 1) * (1 + max(z - toxicity.CHANCE, 0) ** 2)

    def vector(bag):
        raw = {w: (1 + math.log(c)) * weight[w] for w, c in bag.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values())) or 1
        return {w: x / norm for w, x in raw.items()}

    return vector, {i: vector(b) for i, b in bags.items()}, groups


def plain_nearest(vector, vectors, skip=()):
    scores = sorted((-sum(x * v.get(w, 0) for w, x in vector.items()), i) for i, v in vectors.items() if i not in skip)
    return [(i, -s) for s, i in scores if s < -1e-12][: toxicity.NEIGHBOURS]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    every = {r.doc_id: r.text for r in docs.collect()}
    return every, sorted((r.doc_id, r.toxic, every[r.doc_id]) for r in labels.collect() if r.doc_id in every and zlib.crc32(str(r.doc_id).encode()) % 5)


def test_against_brute_force(spark, rows):
    every, known = rows
    vector, vectors, groups = plain_model(known)
    label = {i: y for i, y, _ in known}

    def vote(near):
        return sum(s * s * label[i] for i, s in near) / (sum(s * s for _, s in near) + 0.05)

    apart = [i for i, _, _ in known if toxicity.set_apart(i, toxicity.APART, "toxicity")]
    votes = [vote(plain_nearest(vectors[i], vectors, {j for j in vectors if groups[j] == groups[i]})) for i in apart]
    slope, offset = toxicity._platt(np.array([*votes, 0.0]), np.array([*(label[i] for i in apart), 0.0]))
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, SF).collect()}
    assert got.keys() == every.keys()
    for i, text in every.items():
        near = plain_nearest(vector(Counter(w for w in plain_words(text) if w)), vectors)
        want = 1 / (1 + math.exp(-max(-30, min(30, slope * vote(near) + offset))))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        cosine = {j: sum(x * vectors[j].get(w, 0) for w, x in vector(Counter(w for w in plain_words(text) if w)).items()) for j in got[i].neighbours}
        assert [cosine[j] for j in got[i].neighbours] == pytest.approx([s for _, s in near[:5]], abs=1e-9)


def test_index_holds_the_whole_sample(spark, rows):
    """All sampled rows of both labels with all their words; hardly a document is without neighbour."""
    every, known = rows
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(model.ids.tolist()) == [i for i, _, _ in known] and model.labels.sum() == sum(y for _, y, _ in known)
    assert model.words.keys() == {w for _, _, t in known for w in plain_words(t) if w}
    alone = sum(not model.nearest(model.vector(toxicity.words_of((t or "").encode()))) for t in every.values())
    assert alone < 0.05 * len(every)


def test_nearest_is_exact():
    """Short and long lists, blocks that stay closed, ties, and groups left out."""
    random.seed(4)
    words = {f"t{i}".encode(): i for i in range(40)}
    made = []
    for i in range(1000):
        topic = i % 5
        at = sorted({topic, *(5 + topic * 7 + random.randrange(7) for _ in range(random.choice([1, 2, 4])))})
        w = np.array([random.choice([0.25, 0.5, 1.0]) for _ in at])
        made.append((i, i % 2, i // 3, (np.array(at), w / np.sqrt((w * w).sum()))))
    model = toxicity.Model.build(words, np.ones(40), made)
    assert (model.place >= 0).any() and (model.place < 0).any() and model.most.shape[1] == 16
    vectors = {i: dict(zip(v[0].tolist(), v[1].tolist())) for i, _, _, v in made}
    for i, _, group, query in made[::17]:
        for without in (None, group):
            scores = sorted((-round(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), 12), j) for j, _, g, _ in made if g != without)
            want = [(j, -s) for s, j in scores if s < 0][:15]
            assert [(int(model.ids[row]), s) for row, s in model.nearest(query, without=without)] == want


def test_edges(spark):
    """Nulls, long texts, repeated ids with two texts, ties of labels, clashing names, empty tables."""
    calm, rude = ["the river runs by the old mill and the trees", "we walked over the hill to see the sea today"], ["idiot", "moron", "scum"]
    random.seed(5)
    texts = []
    for i in range(300):
        words = " ".join(random.choice(calm) for _ in range(6)).split()
        random.shuffle(words)
        if i % 5 == 0:
            words[3:3] = random.sample(rude, 2)
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts + ODD)] + [(2, "zzz second text of one id", "en", "s", 1), (None, texts[0], "en", "s", 1)], DOCS)
    docs = docs.select("*", F.lit(1).alias("evidence"), F.lit("x").alias("n0"), F.lit(2).alias("k0"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (1, None), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.fit(docs.repartition(7), labels).ids.tolist() == model.ids.tolist()
    out = toxicity.score(docs, model, keep=docs.columns).collect()
    assert len(out) == 302 + len(ODD) and {"n0", "k0", "text", "evidence"} <= set(out[0].asDict())
    got = {r.doc_id: r for r in out if not (r.text or "").startswith("zzz")}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300)) and set(got[0].evidence) & {"idiot", "moron", "scum"} and got[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in out) and not any(got[300 + k].predicted for k in range(len(ODD)))
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("predicted <> 0").count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 1"))).filter("predicted <> 1").count() == 0
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fit_gives_memory_back(spark):
    """After a fit on a few thousand texts the driver's Python keeps little more than the model."""
    own = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1e3
    word = lambda i: F.translate(F.pmod(F.xxhash64("doc_id", i), F.lit(100_000)).cast("string"), "0123456789", "abcdefghij")
    ids = spark.range(5_000).withColumnRenamed("id", "doc_id")
    docs, labels = ids.withColumn("text", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(800)), word), " ")), ids.withColumn("toxic", (F.col("doc_id") % 2).cast("int"))
    toxicity.fit(docs.limit(100), labels)
    shared.give_back()
    before = own()
    model = toxicity.fit(docs, labels)
    assert len(model.ids) > 3_000 and own() - before < 110
