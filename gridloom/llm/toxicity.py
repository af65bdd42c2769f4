"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

1. A bounded sample of labelled documents (EXAMPLES rows, about) is the index: all of its
   rows, of both labels, with all of their words.  Weights are (1 + log tf) * idf * emphasis;
   the emphasis is 1 or more and grows with the z score of the word's log odds for label
   1, as plain idf finds neighbours by topic.  No word is left out of the vectors.
2. Words of few examples have short posting lists, which are summed up exactly.  Words of
   many have long lists, kept by block of BLOCK examples with the largest weight in each.
3. A document's neighbours are found exactly: a block's upper bound is its best sum over
   short lists plus the query's weights times the block maxima of the long ones; blocks
   are opened from the highest bound on until no other can hold a better neighbour.
4. Votes weighted by cosine, calibrated by leaving out each row's own group of copies, give
   the score; heavy words shared with neighbours and the neighbours' ids are the evidence.

The index is bounded by the sample and does not grow with the corpus; all documents are
scored in one scan, a repeated text of a batch once.

Rules: a null, empty or wholly unknown text has no neighbour, so no votes.  Rows with null
doc_id are scored but never learned from; of repeated labels the larger counts; of several
texts under one labelled id the smallest is learned from.  Without labels of both kinds
every score is 0, or 1 if all are 1.  Repeated rows are scored alike; other columns play no
part, and kept columns of the names of new ones are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_part, give_back, sampled, set_apart, table, with_text_columns

#: Labelled documents in the index, at most (about).
EXAMPLES = 4_000
NEIGHBOURS, BLOCK = 15, 64
#: A word of more than one example in LONG has a long list.
LONG = 16
FIRST = 4  # blocks opened before the first look at the bounds
#: z scores up to this are taken for chance; beyond, the emphasis grows with the square.
CHANCE = 2.0
#: Of these rows one in APART calibrates the votes.
APART = 4
#: Everything in ASCII but letters is a gap; capitals become small.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

Vector = tuple[np.ndarray, np.ndarray]  # word numbers, ascending, and weights


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def copy_key(words: Sequence[bytes]) -> int:
    """Smallest hash of the five-word shingles: near copies mostly share it."""
    return min((zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0)


def _platt(votes: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from vote to label, lightly regularised."""
    w = np.zeros(2)
    x = np.stack([votes, np.ones(len(votes))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-2 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def word_weights(bags: Sequence[np.ndarray], words: int, labels: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """idf times emphasis of each word, from the distinct words of each text; a word counts once for a group of copies."""
    number = np.unique(groups, return_inverse=True)[1]
    word, owner, label = np.concatenate(bags).astype(np.int64), np.repeat(number, [len(x) for x in bags]), np.repeat(labels, [len(x) for x in bags])
    per_word = lambda mask: np.bincount(np.unique(owner[mask] * words + word[mask]) % words, minlength=words).astype(float)
    df, a = per_word(label >= 0), per_word(label == 1)
    n, n1 = len(np.unique(groups)), len(np.unique(groups[labels == 1]))
    n0, b = n - n1, np.minimum(df - a, n - n1)
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    z = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    return (np.log((1 + n) / (1 + df)) + 1) * (1 + np.maximum(z - CHANCE, 0) ** 2)


@dataclass
class Model:
    words: dict[bytes, int]
    weight: np.ndarray  # idf times emphasis of each word
    ids: np.ndarray  # of the examples
    labels: np.ndarray
    groups: np.ndarray  # examples that are copies of each other share a number
    starts: np.ndarray  # short postings of a word: starts[w] .. starts[w + 1]
    rows: np.ndarray
    weights: np.ndarray
    place: np.ndarray  # number of a word among those with long lists, or -1
    long: np.ndarray  # long list x block x example: weights
    most: np.ndarray  # long list x block: largest weight
    slope: float = 0.0
    offset: float = -30.0

    @classmethod
    def build(cls, words: dict[bytes, int], weight: np.ndarray, examples: Sequence[tuple[int, int, int, Vector]]) -> Model:
        """Examples: (id, label, group, vector).  They are laid out by the frequent words they
        hold, the most frequent first, so that a block's examples are alike and its maxima low."""
        n, blocks = len(examples), -(-len(examples) // BLOCK)
        word = np.concatenate([v[0] for *_, v in examples] or [np.zeros(0, np.int64)])
        weights = np.concatenate([v[1] for *_, v in examples] or [np.zeros(0)])
        rows = np.repeat(np.arange(n), [len(v[0]) for *_, v in examples])
        df = np.bincount(word, minlength=len(words))
        often = np.flatnonzero(df * LONG > n)
        often = often[np.argsort(-df[often], kind="stable")]
        place = np.full(len(words), -1, np.int32)
        place[often] = np.arange(len(often))
        at = place[word]
        holds = np.zeros((n, len(often)), bool)
        holds[rows[at >= 0], at[at >= 0]] = True
        layout = sorted(range(n), key=lambda i: (holds[i].tobytes(), examples[i][0]))
        examples, seat = [examples[i] for i in layout], np.zeros(n, np.int64)
        seat[layout] = np.arange(n)
        rows = seat[rows]
        long = np.zeros((len(often), blocks * BLOCK))
        long[at[at >= 0], rows[at >= 0]] = weights[at >= 0]
        long = long.reshape(len(often), blocks, BLOCK)
        order = np.argsort(word, kind="stable")
        order = order[at[order] < 0]
        ids, labels, groups = (np.array([x[k] for x in examples], kind) for k, kind in enumerate((np.int64, float, np.int64)))
        return cls(words, weight, ids, labels, groups, np.searchsorted(word[order], np.arange(len(words) + 1)), rows[order].astype(np.int32), weights[order], place, long, long.max(axis=2, initial=0))

    def vector(self, words: Sequence[bytes]) -> Vector:
        """Unit TF-IDF weights; words of no example are no dimensions."""
        number = np.array([self.words.get(w, -1) for w in words], np.int32)
        return self.weighted(number[number >= 0])

    def weighted(self, number: np.ndarray) -> Vector:
        word, tf = np.unique(number, return_counts=True)
        raw = (1 + np.log(tf)) * self.weight[word]
        return word, raw / math.sqrt((raw * raw).sum() or 1.0)

    def nearest(self, vector: Vector, k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[int, float]]:
        """(row, cosine) of the k examples of highest cosine (ties: smaller id), exactly; only those above 0.

        `without`: a group of copies that takes no part."""
        word, query = vector
        blocks = self.most.shape[1]
        if not len(word) or not blocks:
            return []
        at = self.place[word]
        short, far = at < 0, at[at >= 0]
        first, counts = self.starts[word[short]], self.starts[word[short] + 1] - self.starts[word[short]]
        every = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        scores = np.zeros((blocks, BLOCK))
        scores += np.bincount(self.rows[every], self.weights[every] * np.repeat(query[short], counts), blocks * BLOCK).reshape(blocks, BLOCK)
        weight = query[~short]
        bounds = scores.max(axis=1) + weight @ self.most[far]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        found, left = order[:0], order[:FIRST]
        for _ in range(2):  # the best bounds first, then all blocks that the k-th best so far leaves open
            if len(far):
                scores[left] += (weight @ self.long[far[:, None], left[None, :]].reshape(len(far), -1)).reshape(-1, BLOCK)
            found = np.concatenate([found, left])
            rows = (found[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            rows = rows[rows < len(self.ids)]
            if without is not None:
                rows = rows[self.groups[rows] != without]
            best = np.round(scores.reshape(-1)[rows], 12)
            least = np.partition(best, -k)[-k] if len(best) >= k else 0.0
            left = order[len(found) :]
            left = left[bounds[left] >= least - 1e-9]
        keep = np.flatnonzero((best >= least) & (best > 0))
        keep = keep[np.lexsort((self.ids[rows[keep]], -best[keep]))][:k]
        return list(zip(rows[keep].tolist(), best[keep].tolist()))

    def __getstate__(self) -> dict:
        """What tasks are sent: words as one string and long lists without their zeros."""
        at = np.flatnonzero(self.long)
        return {**self.__dict__, "words": b" ".join(self.words), "long": (self.long.shape, at.astype(np.int32), self.long.reshape(-1)[at])}

    def __setstate__(self, state: dict) -> None:
        shape, at, weights = state["long"]
        long = np.zeros(math.prod(shape))
        long[at] = weights
        self.__dict__.update(state, words={w: i for i, w in enumerate(state["words"].split(b" "))} if state["words"] else {}, long=long.reshape(shape))

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Cosine-weighted share of label 1; far neighbours count for little."""
        total = sum(s * s for _, s in near)
        return sum(s * s * self.labels[row] for row, s in near) / (total + 0.05)

    def score(self, near: list[tuple[int, float]]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.vote(near) + self.offset))))


def fit_rows(rows: Sequence[tuple[int, int, bytes | None]]) -> Model:
    """The index and its calibration from (id, label, text)."""
    rows = sorted(rows, key=lambda r: r[0])
    labels = np.array([r[1] for r in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        model = Model.build({}, np.zeros(0), [])
        model.offset = 30.0 if labels.any() else -30.0
        return model
    words: dict[bytes, int] = {}
    texts, keys = [], []  # word numbers only: a text is let go before the next is cut
    for *_, text in rows:
        cut = words_of(text)
        keys.append(copy_key(cut))
        texts.append(np.array([words.setdefault(w, len(words)) for w in cut], np.int32))
    groups = np.array(keys, np.int64)
    bags = [np.unique(x) for x in texts]
    weight = word_weights(bags, len(words), labels, groups)
    blank = Model.build(words, weight, [])
    vectors = [blank.weighted(x) for x in texts]
    model = Model.build(words, weight, [(r[0], r[1], g, v) for r, g, v in zip(rows, groups.tolist(), vectors)])
    apart = [i for i, r in enumerate(rows) if set_apart(r[0], APART, "toxicity")]
    votes = [model.vote(model.nearest(vectors[i], without=groups[i])) for i in apart]
    model.slope, model.offset = _platt(np.array([*votes, 0.0]), np.array([*labels[apart].tolist(), 0.0]))
    return model


def labelled(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, toxic, text of a hash sample of the labelled rows that may be learned from."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_part("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = sampled(known, examples, known.count(), "doc_id")
    # `chosen` has about `examples` rows of two numbers at most, so it may go to all tasks
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit(documents: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Learn from a bounded sample of labelled rows, which is gathered here."""
    rows = labelled(documents, labels, examples).withColumn("text", F.col("text").cast("binary")).collect()
    model = fit_rows([(r["doc_id"], r["toxic"], r["text"] and bytes(r["text"])) for r in rows])
    del rows
    give_back()
    return model


def score(documents: DataFrame, model: Model, text: str = "text", keep: Sequence[str] | None = ("doc_id",), prefix: str = "") -> DataFrame:
    """Columns `keep` plus score, predicted, evidence (words) and neighbours (ids of examples)."""

    def compute():
        names = list(model.words)

        def judge(x: bytes | None):
            word, weight = vector = model.vector(words_of(x))
            near = model.nearest(vector)
            value = model.score(near)
            heavy = word[np.argsort(-weight, kind="stable")[:5]].tolist()
            return value, int(value >= 0.5), [names[t].decode("utf-8", "replace") for t in heavy], model.ids[[row for row, _ in near[:5]]].tolist()

        def run(texts):
            once: dict[bytes | None, tuple] = {}
            out = [once.get(x) or once.setdefault(x, judge(x)) for x in texts]
            return list(zip(*out)) or [[]] * 4

        return run

    return with_text_columns(documents, text, f"`{prefix}score` double, `{prefix}predicted` int, `{prefix}evidence` array<string>, `{prefix}neighbours` array<bigint>", compute, keep)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    out = score(documents, model)
    return out.select("doc_id", (crc_part("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence", "neighbours")
