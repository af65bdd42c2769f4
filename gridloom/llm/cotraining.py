"""Quality classifier by co-training of a text-content view and a page-metadata view.

Each view is a logistic model.  They start from the labelled sample; in each round a view
labels those unlabelled documents of which it is sure, and the other view learns from
them.  A view may hand on labels only where its sure labels were right on labelled rows
kept apart.  In the end both views are calibrated on those rows and combined there, and
one scan scores all documents.

Text view: ratios of marks, capitals, digits and repeats among the words, and the words
themselves, hashed.  Metadata view: source, lang, length and the layout of the page (how
many lines, how long, how even, how many repeated or ended), but none of its words.
Fitting reads bounded hash samples (LABELLED, UNLABELLED ids, about); only their numbers
reach the driver.

Rules: null texts, sources, languages and lengths have feature values of their own; rows
without doc_id are scored but not learned from; of repeated labels the larger counts; of
several rows under one id the smallest is learned from.  With labels of one kind or none
every score is that label's share, or 0.5.  Repeated rows are scored alike, an empty table
gives no rows, and columns of other names play no part.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import measure
from .shared import crc_part, named, sampled, set_apart, table, with_text_columns

LABELLED, UNLABELLED = 6_000, 6_000
ROUNDS, SURE, RIGHT = 5, 0.95, 0.97
#: Largest share of the unlabelled sample handed on by a view in a round.
SHARE = 0.1
BUCKETS = 64  # for source and for lang
WORDS = 256  # buckets of hashed words


def text_features(text: bytes | None) -> np.ndarray:
    """Content: ratios over the words, and the share of each bucket of hashed words."""
    n_words, chars, symbols, _, repeats, _, bangs, capitals = measure(text)
    n, words = max(n_words, 1), (text or b"").split()
    raw = text or b""
    ratios = [
        np.log1p(n_words), chars / n / 10, min(symbols / n, 3.0), repeats / n, min(bangs / n, 3.0),
        capitals / max(chars, 1), len(set(words)) / n, sum(raw.count(d) for d in b"0123456789") / max(chars, 1), float(n_words < 50),
    ]
    hashed = np.log1p(np.bincount([zlib.crc32(w) % WORDS for w in words], minlength=WORDS))
    return np.concatenate([ratios, hashed / max(np.sqrt((hashed * hashed).sum()), 1.0)])


def layout_features(text: bytes | None) -> np.ndarray:
    """Page metadata: how many lines there are, how long and even, how many are repeated or end in a full stop."""
    lines = (text or b"").split(b"\n")
    filled = [x for x in lines if x and not x.isspace()]
    sizes, distinct = np.array([len(x) for x in lines], float), set(filled)
    n = max(len(filled), 1)
    return np.array([
        np.log1p(len(lines)), np.log1p(sizes.max()), np.log1p(sizes.mean()), sizes.std() / (sizes.mean() + 1), (sizes < 40).mean(), (sizes > 400).mean(),
        1 - len(distinct) / n, sum(x.endswith(b".") for x in filled) / n, np.log1p(sum(map(len, distinct)) / max(len(distinct), 1)),
    ])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton steps on the penalised log likelihood; the last weight is the offset."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if abs(step).max() < 1e-7:
            break
    return w


@dataclass
class Views:
    """Weights of both views, their calibration (slope, offset) and the weights that combine them.

    `means` and `scales` are those of the features of a view."""

    means: list[np.ndarray]
    scales: list[np.ndarray]
    text: np.ndarray
    meta: np.ndarray
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0)] * 2)
    combined: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0, 0.0]))
    handed: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels by round and view


def metadata(source: np.ndarray, lang: np.ndarray, length: np.ndarray, layout: np.ndarray) -> np.ndarray:
    out = np.zeros((len(source), 2 * BUCKETS))
    out[np.arange(len(source)), source] = 1
    out[np.arange(len(source)), BUCKETS + lang] = 1
    return np.column_stack([out, length, layout])


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, labelled: np.ndarray, apart: np.ndarray) -> Views:
    """Rows by view; y counts where `labelled`; rows `apart` are labelled and only calibrate."""
    means, scales = [x.mean(0) for x in (text, meta)], [x.std(0) + 1e-3 for x in (text, meta)]
    views = [(x - m) / s for x, m, s in zip((text, meta), means, scales)]
    train = [labelled & ~apart, labelled & ~apart]
    target = [y.astype(float).copy(), y.astype(float).copy()]
    handed = []
    predict = lambda x, w: 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    weights = [logistic(v[t], c[t]) for v, t, c in zip(views, train, target)]
    for _ in range(ROUNDS):
        given = []
        for k in (0, 1):
            p = predict(views[k], weights[k])
            counts = 0
            for label, sure in ((1, p), (0, 1 - p)):
                seen = apart & (sure >= SURE)
                if not seen.any() or (y[seen] == label).mean() < RIGHT:
                    continue  # not right often enough to teach
                free = np.flatnonzero(~labelled & ~train[1 - k] & (sure >= SURE))
                free = free[np.argsort(-sure[free], kind="stable")][: int(SHARE * (~labelled).sum()) + 1]
                train[1 - k][free] = True
                target[1 - k][free] = label
                counts += len(free)
            given.append(counts)
        handed.append(tuple(given))
        weights = [logistic(v[t], c[t]) for v, t, c in zip(views, train, target)]
        if not sum(given):
            break
    out = Views(means, scales, weights[0], weights[1], handed=handed)
    sums = [v[apart] @ w[:-1] + w[-1] for v, w in zip(views, weights)]
    out.calibration = [tuple(logistic(s[:, None], y[apart], 0.1)) for s in sums]
    out.combined = logistic(np.column_stack([a * s + b for s, (a, b) in zip(sums, out.calibration)]), y[apart], 0.1)
    return out


def bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("")), F.col(name).isNull()), F.lit(BUCKETS)).cast("int")


def length_feature() -> Column:
    return F.log1p(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)).cast("double")) / 10


def features(documents: DataFrame, keep: list[str]) -> DataFrame:
    def compute():
        return lambda texts: [[text_features(x) for x in texts], [layout_features(x) for x in texts]]

    cut = documents.select(*keep, "text", bucket("source").alias("_source"), bucket("lang").alias("_lang"), length_feature().alias("_length"))
    return with_text_columns(cut, "text", "_text array<double>, _layout array<double>", compute, [*keep, "_source", "_lang", "_length"])


def fit(documents: DataFrame, labels: DataFrame) -> Views | float:
    """Fitted views, or the share of label 1 where there is nothing to learn."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_part("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = sampled(known, LABELLED, known.count(), "doc_id")
    there = documents.filter(F.col("doc_id").isNotNull() & (crc_part("doc_id", 5) != 0)).select("doc_id", "text", "source", "lang", "n_chars")
    rest = sampled(there, UNLABELLED, there.count(), "doc_id").join(known, "doc_id", "left_anti").withColumn("quality", F.lit(-1))
    # about LABELLED rows of two numbers at most go to all tasks; texts are not shuffled for them
    chosen = there.join(F.broadcast(some.select("doc_id", "quality")), "doc_id").unionByName(rest)
    # one row an id, so that the sample stays bounded however often an id is repeated
    once = chosen.groupBy("doc_id", "quality").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("row")).select("doc_id", "quality", "row.*")
    rows = sorted(features(once, ["doc_id", "quality"]).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], int)
    labelled = y >= 0
    apart = labelled & (np.array([set_apart(r["doc_id"], 4, "co-training") for r in rows], bool) if rows else labelled)
    if len(set(y[labelled & ~apart])) < 2 or len(set(y[apart])) < 2:
        return float(y[labelled].mean()) if labelled.any() else 0.5
    column = lambda c, kind: np.array([r[c] for r in rows], kind)
    return cotrain(column("_text", float), metadata(column("_source", int), column("_lang", int), column("_length", float), column("_layout", float)), y, labelled, apart)


def score(documents: DataFrame, model: Views | float, keep: list[str]) -> DataFrame:
    """Columns `keep` plus text_score, metadata_score, score (0 to 1) and predicted."""
    kept = [named(c) for c in keep]
    if isinstance(model, float):
        share = F.lit(model)
        return documents.select(*kept, share.alias("text_score"), share.alias("metadata_score"), share.alias("score"), (share >= 0.5).cast("int").alias("predicted"))
    plain = [(w[:-1] / s, w[-1] - (w[:-1] * m / s).sum()) for w, m, s in zip((model.text, model.meta), model.means, model.scales)]
    (text_weights, text_offset), (meta, meta_offset) = plain
    layout = meta[2 * BUCKETS + 1 :]

    def compute():
        return lambda texts: [[float(text_features(x) @ text_weights + text_offset) for x in texts], [float(layout_features(x) @ layout) for x in texts]]

    cut = documents.select(*[c.alias(f"keep{i}") for i, c in enumerate(kept)], "text", bucket("source").alias("_source"), bucket("lang").alias("_lang"), length_feature().alias("_length"))
    own = [f"keep{i}" for i in range(len(keep))]
    scored = with_text_columns(cut, "text", "_text double, _layout double", compute, [*own, "_source", "_lang", "_length"])
    cells = lambda x: F.array(*[F.lit(float(v)) for v in x])
    meta_sum = F.get(cells(meta[:BUCKETS]), F.col("_source")) + F.get(cells(meta[BUCKETS : 2 * BUCKETS]), F.col("_lang")) + F.col("_length") * float(meta[2 * BUCKETS]) + F.col("_layout") + float(meta_offset)
    (a, b), (c, d) = model.calibration
    logits = scored.select(*own, (F.col("_text") * float(a) + float(b)).alias("_t"), (meta_sum * float(c) + float(d)).alias("_m"))
    sigmoid = lambda x: 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))
    u, v, z = (float(x) for x in model.combined)
    total = sigmoid(F.col("_t") * u + F.col("_m") * v + z)
    back = [F.col(o).alias(k) for o, k in zip(own, keep)]
    return logits.select(*back, sigmoid(F.col("_t")).alias("text_score"), sigmoid(F.col("_m")).alias("metadata_score"), total.alias("score"), (total >= 0.5).cast("int").alias("predicted"))


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = score(documents, fit(documents, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.withColumn("held_out", crc_part("doc_id", 5) == 0)
