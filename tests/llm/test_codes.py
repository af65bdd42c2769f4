"""Vector codes against brute force in plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts, entries, rounds, scale=1024):
    kept = [(i, [math.floor(x) * scale if abs(x) > 2**53 else math.floor(x * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < codes.LARGEST for x in v)]
    width = -(-max([len(v) for _, v, _ in kept], default=1) // parts) * parts or parts
    kept = sorted(((i, v + [0] * (width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0))
    cut = width // parts
    pieces = [[v[p * cut : (p + 1) * cut] for _, v, _ in kept] for p in range(parts)]
    books = [[list(x) for x in pieces[p][:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min(range(len(books[p])), key=lambda e: (distance(x, books[p][e]), e)) for x in pieces[p]] for p in range(parts)]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in set(at[p]):
                mine = [x for x, y in zip(pieces[p], at[p]) if y == e]
                books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    at = assign()
    errors = [sum(distance(pieces[p][k], books[p][at[p][k]]) for p in range(parts)) for k in range(len(kept))]
    return [(kept[k][0], tuple(at[p][k] for p in range(parts)), errors[k] if errors[k] < 2**63 else None) for k in range(len(kept))], books


def made(spark, rows, parts, entries, rounds):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit(1)).withColumn("id", F.lit("x")).withColumn("a.b", F.lit(2)).repartition(3)
    vectors = codes.kept_vectors(df, "vec_id", "embedding", "label")
    books, width = codes.train(vectors, parts, entries, rounds)
    return codes.encoded(vectors, books, width), books


ODD = [(900, None, 1), (901, [None, 1.0], 1), (902, [float("nan")], 1), (903, [float("inf"), 0.0], 1), (904, [1e300], 2), (905, [], 3), (None, [0.5, 0.25], None)]


@pytest.mark.parametrize("large", [False, True])
def test_codes(spark, monkeypatch, large):
    monkeypatch.setattr(codes, "RUN", 3)
    random.seed(3)
    rows = [(i, [random.choice([-1.0, -0.3, 0.0, 0.5, 0.2501]) for _ in range(random.choice([8, 8, 7, 3]))], random.choice([None, 1, 2])) for i in range(150)]
    rows += [(300 + i, [0.5] * 8, 1) for i in range(20)] + ODD
    if large:
        rows += [(400, [1e12, -1e12, 3.0], 1), (401, [1e12 + 1, -1e12, 3.0], 1), (402, [1e15] * 8, 2)]
    got, books = made(spark, rows, 2, 20, 4)
    expected, brute_books = brute(rows, 2, 20, 4)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.id, tuple(r.code), r.error) for r in got.collect()), key=key) == expected
    assert [b.entries for b in books] == brute_books
    assert codes.digest_of(books) == hashlib.sha256(",".join(str(y) for b in brute_books for e in b for y in e).encode()).hexdigest()


def test_search_is_exact():
    rng = np.random.default_rng(5)
    for spread in (2, 40, 3_000):
        entries = rng.integers(-spread, spread, (256, 16))
        entries[100:120] = entries[5:25]  # equal entries: the lowest index
        x = rng.integers(-spread, spread, (500, 16)).astype(float)
        x[:50] = x[:50] + spread * 3
        index, far = codes.Codebook(entries.tolist()).nearest(x)
        whole = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        assert (index == whole.argmin(1)).all() and (far == whole.min(1)).all()


def test_few_and_no_vectors(spark):
    for rows in ([], [(7, [0.1, 0.2, 0.3], 1)], [(900, None, 1)]):
        got, books = made(spark, rows, 4, 256, 2)
        assert [(r.id, r.code, r.error) for r in got.collect()] == [(7, [0, 0, 0, 0], 0)][: 1 if rows and rows[0][1] else 0]
        assert all(len(b.entries) <= 1 for b in books)


def test_decoding(spark):
    rows = [(i, [i / 8, -i / 16, 0.5, 0.0], 0) for i in range(10)]
    got, books = made(spark, rows, 2, 256, 1)
    back = {r.id: r.approximation for r in codes.decoded(got, books).collect()}
    assert back == {i: v for i, v, _ in rows}


def test_query_edges(spark, tmp_path):
    """Repeated rows, label sums with nulls together, and a table of no vector."""
    from gridloom.llm import queries

    spark.createDataFrame([(1, [0.25] * 8, None), (1, [0.25] * 8, None), (2, [0.5] * 8, 4), *ODD[:4]], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = sorted(queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect())
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in rows] == [(1, "00000000", 0, 0), (1, "00000000", 0, 0), (2, "02020202", 0, 0)]
    spark.createDataFrame(ODD[:1], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.QUERIES["op13_vector_codes"](spark, f"{tmp_path}/none").count() == 0
