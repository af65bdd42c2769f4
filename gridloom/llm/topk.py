"""Exact top-k inner products by pivot-table elimination.

Distances of every vector to PIVOTS fixed vectors are computed once and kept with it.
For a query q and a vector x, max over pivots of |d(q, p) - d(x, p)| is a lower bound
of d(q, x), so (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product.
Candidates are evaluated in waves in the order of that bound until the k-th score rules out
the rest; on integers this is exact, ties included.  How many the bound rules out depends on the
vectors: of evenly spread directions hardly any (see the README).

Queries and vectors are dealt to blocks by a hash of the row and met block by block
(QUERIES x ROWS at most), so a task holds two blocks whatever the table's size; the
best k of each block are merged per query.

Rules: components are floor(scale * x); vectors that are null or hold a null, NaN or
infinity take no part, as queries or candidates, nor do those with a component beyond the range of long;
scores are exact whole numbers of any size, and one beyond the range of long is ranked by its value but shown as NULL; vectors of unequal length are padded
with zeros; rows with a null id take no part as queries (no id to report) nor as
candidates.  Repeated ids are rows of their own, but a query is never paired with a
row of its own id.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, table

PIVOTS = 24
#: Vectors from which the pivots are chosen (a bound on what is collected).
PIVOT_POOL = 1_024
ROWS, QUERIES = 16_384, 2_048
STEP = 512  # candidates evaluated at first
#: More than any score of components within long, so that sums with it are positive.
OFFSET = 1 << 160


def integer_vectors(df: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<bigint>) of the rows that take part."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(2.0**63)))
    return df.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_column).cast("bigint").alias("id"), F.transform(parts, lambda x: F.floor(x * scale).cast("bigint")).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return out


def choose_pivots(vectors: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors out of a bounded pool: each next pivot is the one farthest from those chosen."""
    pool = [r["v"] for r in vectors.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_POOL).collect()]
    width = max((len(v) for v in pool), default=1)
    x = _matrix(pool, max(width, 1))
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def with_distances(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The pivot table: d array<double>, distances to the pivots, beside each vector."""

    @F.pandas_udf("array<double>")
    def distances(v: pd.Series) -> pd.Series:
        width = max([pivots.shape[1], *(len(x) for x in v)]) if len(v) else 1
        x, p = _matrix(v, width), _matrix(pivots, width)
        square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T
        return pd.Series(list(np.sqrt(np.maximum(square, 0))))

    return vectors.withColumn("d", distances("v"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(score) > k and score.dtype != object:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        score, ids = score[at], ids[at]
    keep = np.lexsort((ids, -score))[:k]
    return score[keep], ids[keep]


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score): the best k rows of this block for each query.

    The candidates of the highest bounds are evaluated first, and then in waves those whose bound
    is not below the k-th score so far, until none is left."""
    width = max(len(x) for part in (queries, rows) for x in part["v"])
    x, q = _matrix(rows["v"], width), _matrix(queries["v"], width)
    ids, dx, dq = rows["id"].to_numpy(), np.stack(rows["d"].to_list()).T.copy(), np.stack(queries["d"].to_list())
    high = max(abs(x).max(initial=0), abs(q).max(initial=0))
    exact = width * high * high < 2**53  # else floats would round the products
    if not exact:
        x, q = _integers(rows["v"], width), _integers(queries["v"], width)
    xx, qq = (x * x).sum(1).astype(float), (q * q).sum(1).astype(float)
    gap, low = np.empty(len(ids)), np.empty(len(ids))
    out = []
    for number, query in enumerate(queries["id"].to_numpy()):
        low[:] = 0
        for at_pivot, own in zip(dx, dq[number]):
            np.maximum(low, np.abs(np.subtract(at_pivot, own, out=gap), out=gap), out=low)
        sizes = xx + qq[number]
        bound = (sizes - low * low) / 2 + 1e-6 + 1e-9 * sizes
        bound[ids == query] = -np.inf
        size = min(STEP, len(ids))
        wave = np.argpartition(-bound, size - 1)[:size]
        best_score, best_id = np.zeros(0, x.dtype), np.zeros(0, np.int64)
        while len(wave := wave[bound[wave] > -np.inf]):
            # a product over the whole block is cheaper than gathering most of it
            score = (x @ q[number])[wave] if len(wave) * 4 > len(ids) else x[wave] @ q[number]
            best_score, best_id = _best(np.concatenate([best_score, score]), np.concatenate([best_id, ids[wave]]), k)
            bound[wave] = -np.inf
            open_rows = np.flatnonzero(bound >= float(best_score[-1])) if len(best_id) == k else np.flatnonzero(bound > -np.inf)
            size = min(size * 8, len(open_rows))
            wave = open_rows[np.argpartition(-bound[open_rows], size - 1)[:size]] if size else open_rows
        out += [(int(query), int(i), int(s)) for i, s in zip(best_id, best_score)]
    return out


def _integers(vectors, width: int) -> np.ndarray:
    """Python integers for components whose products leave the range of exact floats."""
    out = np.zeros((len(vectors), width), object)
    for row, v in enumerate(vectors):
        out[row, : len(v)] = [int(y) for y in v]
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, pivots: np.ndarray | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of two (id, v) frames; ties go to the smaller vec_id."""
    pivots = choose_pivots(rows) if pivots is None else pivots
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    made = materialise(with_distances(rows, pivots))
    asked = materialise(with_distances(queries, pivots))
    blocks, parts = max(1, -(-made.count() // ROWS)), max(1, -(-asked.count() // QUERIES))

    def dealt(df: DataFrame, own: int, other: int, own_name: str, other_name: str) -> DataFrame:
        """Each row to one block of its own side and to all blocks of the other; equal rows are dealt by their place in the written table."""
        return df.withColumn(own_name, F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(own)).cast("int")).withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))

    left = dealt(asked, parts, blocks, "part", "block").groupBy("block", "part")
    right = dealt(made, blocks, parts, "block", "part").groupBy("block", "part")

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = search_block(q, x, k) if len(q) and len(x) else []
        shown = pd.array([s if -(2**63) <= s < 2**63 else None for *_, s in found], dtype="Int64")
        # texts of one length that sort like the scores
        return pd.DataFrame({"query_id": np.array([a for a, *_ in found], np.int64), "vec_id": np.array([b for _, b, _ in found], np.int64), "score": shown, "place": [f"{s + OFFSET:050d}" for *_, s in found]})

    near = left.cogroup(right).applyInPandas(meet, "query_id bigint, vec_id bigint, score bigint, place string")
    best = Window.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256))
    return top_k(vectors.filter(F.col("id") % 50 == 0), vectors)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         list_sum(list_transform(range(1, least(len(q.e), len(x.e)) + 1), lambda i: q.e[i] * x.e[i]))::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""
