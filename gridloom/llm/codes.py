"""Vector code compression: product quantisation with equal-average nearest-entry search.

A vector is cut into equal parts; each part position has a codebook of entries, and a
vector's code is the index of the nearest entry of each part.  Codebooks begin as parts of
the first vectors and follow the means of what is assigned to them for a few rounds.

Search.  The squared difference of two component sums over the part's dimension is never above
their squared distance.  Entries are kept sorted by their sum and cut into runs of RUN; a
part looks at the run around its own sum and then outward, one run below and one above at a time,
until on each side the squared gap to the next run's sum over the dimension strictly exceeds the
best distance.  Entries of equal distance are all met, so ties go to the lowest index.

All arithmetic is on integers: components are floor(SCALE * x), held as doubles where every
intermediate result is an exact whole number, and as Python integers otherwise.

A round is one pass of the vectors, cut in tasks of Arrow batches that each hand on one row of
sums per (part, entry); the driver gets one row per entry (PARTS x ENTRIES at most).

Rules: vectors that are null or hold a null, NaN or infinity, or a component of 1e22 or more,
take no part.  Vectors of unequal length are padded with zeros to the longest one, that to a multiple
of the number of parts.  The first vectors are those of the smallest ids, then by content, missing
ids last; fewer vectors than ENTRIES give as many entries.  Repeated rows are rows of their own.  An
error beyond the range of long is NULL, as is a label's sum of them.  Columns other than id,
vector and label are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, named, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries looked at together, in the order of their sums.
RUN = 16
#: Components from here on are treated like infinite ones.
LARGEST = 1e22
#: Where the largest component times the width stays below this, every intermediate result is an exact double.
EXACT = 2.0**25
#: Labels whose sums are sent to every task; more are joined by shuffle.
FEW_LABELS = 20_000
LONG_MAX = 2**63 - 1


def kept_vectors(df: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    """(id, v array<double>, label) of the rows that take part."""
    parts = F.transform(named(vector), lambda x: x.cast("double"))
    ok = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(LARGEST)))
    return df.filter(named(vector).isNotNull() & F.coalesce(ok, F.lit(False))).select(named(id_column).cast("bigint").alias("id"), parts.alias("v"), named(label).alias("label"))


def whole_components(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A matrix of floor(SCALE * x), doubles if exact everywhere, else Python integers; rows are padded with zeros."""
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)
    # a power of two times a double is exact
    scaled = np.floor(flat * SCALE)
    exact = not len(flat) or abs(scaled).max() * width < EXACT
    out = np.zeros((len(sizes), width), float if exact else object)
    out[row, column] = scaled if exact else [int(x) for x in scaled]
    return out


def _batch(batch: pa.RecordBatch, width: int) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return whole_components(v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy(), width)


@dataclass
class Codebook:
    """Entries of one part position, with what the search needs: entries by sum, in runs."""

    entries: list[list[int]]

    def __post_init__(self) -> None:
        matrix = np.array(self.entries, object) if self.entries else np.zeros((0, 1), object)
        exact = max((abs(x) for x in matrix.flat), default=0) * matrix.shape[1] < EXACT
        self.kind = float if exact else object
        totals = matrix.sum(1)
        self.order = np.array(sorted(range(len(totals)), key=lambda i: (totals[i], i)), np.int64)
        self.sorted = matrix[self.order].astype(self.kind)
        self.totals = totals[self.order].astype(self.kind)
        self.squares = (self.sorted * self.sorted).sum(1)
        self.first = np.arange(0, len(totals), RUN)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equals, and its squared distance."""
        kind = float if x.dtype == float and self.kind is float else object
        x, dimension = x.astype(kind), x.shape[1]
        totals, entries, squares = self.totals.astype(kind), self.sorted.astype(kind), self.squares.astype(kind)
        own, size = x.sum(1), (x * x).sum(1)
        runs = len(self.first)
        last = np.minimum(self.first + RUN, len(totals)) - 1
        home = np.clip(np.searchsorted(totals[self.first], own, "right") - 1, 0, runs - 1)
        best, index = np.full(len(x), None if kind is object else np.inf, kind), np.full(len(x), len(totals), np.int64)
        seen = np.zeros(len(x), bool)

        def look(run: int, rows: np.ndarray) -> None:
            at = slice(self.first[run], last[run] + 1)
            far = size[rows, None] + squares[None, at] - 2 * (x[rows] @ entries[at].T)
            least = far.min(1)
            # of equal distances the lowest index, which need not be the first by sum
            number = np.where(far == least[:, None], self.order[None, at], len(totals)).min(1)
            fresh = ~seen[rows]
            better = fresh.copy()
            old = ~fresh
            better[old] = (least[old] < best[rows[old]]) | ((least[old] == best[rows[old]]) & (number[old] < index[rows[old]]))
            best[rows[better]], index[rows[better]] = least[better], number[better]
            seen[rows] = True

        by_home = [np.flatnonzero(home == h) for h in range(runs)]
        for h, rows in enumerate(by_home):
            if len(rows):
                look(h, rows)
        for h, rows in enumerate(by_home):
            open_rows = {-1: rows, 1: rows}
            for step in range(1, runs):
                for side in (-1, 1):
                    run, left = h + side * step, open_rows[side]
                    if len(left) and 0 <= run < runs:
                        # the nearest sum of the run; all that lie further out have larger gaps
                        gap = own[left] - totals[last[run] if side < 0 else self.first[run]]
                        open_rows[side] = left = left[gap * gap <= best[left] * dimension]
                        if len(left):
                            look(run, left)
        return index, best


def first_codebooks(vectors: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> list[Codebook]:
    """Parts of the vectors of the smallest ids."""
    rows = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    flat = np.array([x for r in rows for x in r["v"]], float)
    whole = whole_components(flat, np.cumsum([0, *(len(r["v"]) for r in rows)]), width)
    cut = width // parts
    return [Codebook([[int(y) for y in row[p * cut : (p + 1) * cut]] for row in whole]) for p in range(parts)]


def next_codebooks(vectors: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """Each entry moved to the floor of the mean of the parts assigned to it; unused ones stay."""
    cut = width // len(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b.entries), cut), object) for b in books]
        counts = [np.zeros(len(b.entries), np.int64) for b in books]
        for batch in batches:
            whole = _batch(batch, width)
            for p, book in enumerate(books):
                x = whole[:, p * cut : (p + 1) * cut]
                index, _ = book.nearest(x)
                if x.dtype == float:
                    for c in range(cut):  # a batch's sums of exact doubles are exact
                        sums[p][:, c] += np.bincount(index, x[:, c], len(book.entries)).astype(np.int64).astype(object)
                else:
                    np.add.at(sums[p], index, x)
                counts[p] += np.bincount(index, minlength=len(book.entries))
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([int(e) for _, e in used], pa.int32()),
            "n": pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
            "total": pa.array([[str(int(y)) for y in sums[p][e]] for p, e in used], pa.list_(pa.string())),
        })

    made = vectors.select("v").mapInArrow(assign, "part int, entry int, n bigint, total array<string>")
    whole = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[c].cast("decimal(38,0)")) for c in range(cut)]).alias("total"))
    moved = [list(b.entries) for b in books]
    for r in whole.collect():  # one row an entry
        moved[r["part"]][r["entry"]] = [int(t) // r["n"] for t in r["total"]]
    return [Codebook(b) for b in moved]


def encoded(vectors: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """(id, label, code array<int>, error): the nearest entry of each part and the sum of squared distances."""
    cut = width // max(len(books), 1)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _batch(batch, width)
            found = [book.nearest(whole[:, p * cut : (p + 1) * cut]) for p, book in enumerate(books)]
            errors = [int(sum(int(e[i]) for _, e in found)) for i in range(len(whole))]
            codes = np.stack([index for index, _ in found], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), len(books)).cast(pa.list_(pa.int32())),
                pa.array([e if e <= LONG_MAX else None for e in errors], pa.int64()),
            ], names=["id", "label", "code", "error"])

    schema = f"id bigint, label {vectors.schema['label'].dataType.simpleString()}, code array<int>, error bigint"
    return vectors.select("id", "label", "v").mapInArrow(encode, schema)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[list[Codebook], int]:
    """Codebooks by part position, and the width of the padded vectors.  `vectors` is read once a round."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 1
    width = -(-longest // parts) * parts
    books = first_codebooks(vectors, width, parts, entries)
    for _ in range(rounds if books[0].entries else 0):
        books = next_codebooks(vectors, books, width)
    return books, width


def decoded(codes: DataFrame, books: list[Codebook]) -> DataFrame:
    """Adds `approximation`: the entries of the code put together, divided by SCALE again."""
    literal = F.array(*[F.array(*[F.array(*[F.lit(float(y) / SCALE) for y in e]) for e in b.entries]) for b in books])
    return codes.withColumn("approximation", F.flatten(F.transform("code", lambda c, p: F.get(F.get(literal, p), c))))


def digest_of(books: list[Codebook]) -> str:
    return sha256(",".join(str(y) for b in books for e in b.entries for y in e).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialise(kept_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    books, width = train(vectors)
    made = materialise(encoded(vectors, books, width))
    # a sum beyond long is NULL, like one that holds an error beyond it
    total = F.when(F.count_if(F.col("error").isNull()) == 0, F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint"))
    labels = materialise(made.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"))
    few = labels.count() <= FEW_LABELS
    out = made.join(F.broadcast(labels) if few else labels, F.col("label").eqNullSafe(F.col("of")), "left")
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return out.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rounds as a chain of CTEs, every part against every entry."""
    nearest = "SELECT x.rid, x.part, min_by(b.entry, (b.far, b.entry)) AS entry, min(b.far) AS far FROM x, LATERAL (SELECT entry, list_sum(list_transform(range(1, len(x.e) + 1), lambda i: (x.e[i] - b{0}.e[i]) * (x.e[i] - b{0}.e[i]))) AS far FROM b{0} WHERE b{0}.part = x.part) b GROUP BY x.rid, x.part"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"x AS MATERIALIZED (SELECT rid, p AS part, e[p * len(e) // {parts} + 1 : (p + 1) * len(e) // {parts}] AS e FROM v, range({parts}) AS r(p))",
        f"b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, e FROM x WHERE rid <= {entries})",
    ]
    for k in range(rounds):
        ctes += [
            f"n{k} AS MATERIALIZED ({nearest.format(k)})",
            f"m{k} AS MATERIALIZED (SELECT part, entry, i, floor(sum(x.e[i])::DOUBLE / count(*))::BIGINT AS y FROM n{k} JOIN x USING (rid, part), LATERAL (SELECT unnest(range(1, len(x.e) + 1)) AS i) GROUP BY part, entry, i)",
            f"b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(g.e, b{k}.e) AS e FROM b{k} LEFT JOIN (SELECT part, entry, list(y ORDER BY i) AS e FROM m{k} GROUP BY part, entry) g USING (part, entry))",
        ]
    ctes += [
        f"n AS MATERIALIZED ({nearest.format(rounds)})",
        f"d AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})",
        "c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM n GROUP BY rid)",
    ]
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), d"


OP13_SQL = _sql()
