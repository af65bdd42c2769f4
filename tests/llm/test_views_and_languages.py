"""Co-training and language identification against plain restatements."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from gridloom.llm import cotraining, langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_cotrain(views, y, labelled, apart, rounds):
    """The stated exchange, row by row: (numbers handed on by round and view, weights of both views)."""
    known = [{i: int(y[i]) for i in range(len(y)) if labelled[i] and not apart[i]} for _ in views]
    fit = lambda k: cotraining.logistic(views[k][sorted(known[k])], np.array([known[k][i] for i in sorted(known[k])], float))
    weights, handed = [fit(0), fit(1)], []
    limit = int(cotraining.SHARE * sum(not x for x in labelled)) + 1
    for _ in range(rounds):
        given = []
        for k in (0, 1):
            p = [1 / (1 + np.exp(-max(-30, min(30, row @ weights[k][:-1] + weights[k][-1])))) for row in views[k]]
            n = 0
            for label in (1, 0):
                sure = [q if label else 1 - q for q in p]
                seen = [i for i in range(len(y)) if apart[i] and sure[i] >= cotraining.SURE]
                if not seen or sum(y[i] == label for i in seen) / len(seen) < cotraining.RIGHT:
                    continue
                free = [i for i in range(len(y)) if not labelled[i] and i not in known[1 - k] and sure[i] >= cotraining.SURE]
                for i in sorted(free, key=lambda i: -sure[i])[:limit]:
                    known[1 - k][i] = label
                    n += 1
            given.append(n)
        handed.append(tuple(given))
        weights = [fit(0), fit(1)]
        if not sum(given):
            break
    return handed, weights


def test_exchange_against_brute_force():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    text, meta = y[:, None] + rng.normal(0, 0.3, (400, 2)), y[:, None] * [1, 0] + rng.normal(0, 0.25, (400, 2))
    labelled = np.arange(400) < 120
    apart = labelled & (np.arange(400) % 4 == 0)
    got = cotraining.cotrain(text, meta, np.where(labelled, y, -1), labelled, apart)
    views = [(x - x.mean(0)) / (x.std(0) + 1e-3) for x in (text, meta)]
    handed, weights = plain_cotrain(views, y, labelled, apart, cotraining.ROUNDS)
    assert got.handed == handed and all(a > 0 and b > 0 for a, b in handed[:1])
    assert np.allclose(got.text, weights[0]) and np.allclose(got.meta, weights[1])


def test_logistic_is_a_minimum():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200).astype(float)
    loss = lambda w: np.log1p(np.exp(-(2 * y - 1) * (x @ w[:3] + w[3]))).sum() + 0.5 * (w[:3] @ w[:3]) + 0.5e-3 * w[3] ** 2
    w = cotraining.logistic(x, y)
    assert all(loss(w) <= loss(w + 1e-3 * step) for step in np.vstack([np.eye(4), -np.eye(4)]))


def test_views_of_documents(spark):
    """Labels go both ways; scores follow the stated sums; repeated ids stay one row of the fit."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = cotraining.fit(docs, labels)
    again = docs.unionByName(docs.filter("doc_id = 1")).unionByName(docs.filter("doc_id = 1"))
    assert np.allclose(cotraining.fit(again, labels).text, model.text)
    clash = docs.select("*", F.lit(7).alias("_text"), F.lit(8).alias("keep0"), F.lit(9).alias("_m"))
    got = {r.doc_id: r for r in cotraining.score(clash, model, ["doc_id", "_text", "keep0"]).collect()}
    buckets = {r.doc_id: r for r in docs.select("doc_id", cotraining.bucket("source").alias("s"), cotraining.bucket("lang").alias("l"), cotraining.length_feature().alias("n")).collect()}
    for r in docs.collect():
        b = buckets[r.doc_id]
        raw = (r.text or "").encode()
        rows = [cotraining.text_features(raw)[None], cotraining.metadata(np.array([b.s]), np.array([b.l]), np.array([b.n]), cotraining.layout_features(raw)[None])]
        sums = [((x - m) / s) @ w[:-1] + w[-1] for x, m, s, w in zip(rows, model.means, model.scales, (model.text, model.meta))]
        t, m = (a * x[0] + c for x, (a, c) in zip(sums, model.calibration))
        z = model.combined[0] * t + model.combined[1] * m + model.combined[2]
        assert got[r.doc_id].score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6) and got[r.doc_id]._text == 7 and got[r.doc_id].keep0 == 8
    assert cotraining.score(docs.limit(0), model, ["doc_id"]).count() == 0


def plain_grams(text):
    line = " ".join("".join(c.lower() if not c.isascii() or c.isalpha() else " " for c in text).replace("\t", " ").split(" "))
    line = " " + " ".join(w for w in line.split(" ") if w) + " "
    codes = []
    for i in range(len(line) - langid.GRAM + 1):
        code = 0
        for c in line[i : i + langid.GRAM]:
            code = code << 16 | ((ord(c) ^ ord(c) >> 16) & 0xFFFF)
        codes.append(code)
    return codes


def test_languages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts[r.lang].update(plain_grams(r.text))
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    model = langid.fit(docs)
    # every n-gram is in, in the least power of two of cells that keeps the rate
    most = max(len(n) for n in counts.values())
    assert 2 ** (model.bits - 1) < most * 3 / -math.log(1 - langid.FALSE ** (1 / 3)) <= 2**model.bits and max(model.false) <= langid.FALSE
    cells = lambda code: [(code * m & (2**64 - 1)) >> 64 - model.bits for m in odd]
    bits = {lang: {x for c in codes for x in cells(c)} for lang, codes in counts.items()}
    false = {lang: (len(x) / 2**model.bits) ** 3 for lang, x in bits.items()}
    size = Counter(r.lang for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in rows[:80]:
        codes = plain_grams(r.text or "")
        found = {lang: max(0.0, (sum(all(x in bits[lang] for x in cells(c)) for c in codes) - false[lang] * len(codes)) / (1 - false[lang])) for lang in sorted(bits)}
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
        elif sum(found.values()):
            best = max(sorted(found), key=lambda x: (round(found[x], 6), size[x]))
            assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(found[best] / sum(found.values()), abs=1e-9)


def test_language_edges(spark, monkeypatch):
    """Ties go by name, long texts are read whole, too many languages are refused, texts are not read to count them."""
    random.seed(6)
    texts = [("x", "aaaa bbbb"), ("y", "aaaa bbbb"), ("z", "cccc dddd " * 300_000)]
    docs = spark.createDataFrame([(i * 4 + k, t, lang, "s", 1) for k in range(4) for i, (lang, t) in enumerate(texts)], DOCS).select("*", F.lit(1).alias("score"), F.lit("q").alias("lang_pred"))
    model = langid.fit(docs)
    got = langid.identify(docs, model, keep=docs.columns)
    assert {r.lang: r.lang_pred for r in got.collect()} == {"x": "x", "y": "x", "z": "z"} and got.columns[:4] == ["doc_id", "text", "lang", "source"]
    assert langid.identify(docs.limit(0), model).count() == 0
    monkeypatch.setattr(langid, "LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(docs)
