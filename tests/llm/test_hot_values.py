"""Fingerprints of which very many share a band value: chunks met by pattern give the links of all pairs."""

import random

import numpy as np

from gridloom.llm import simhash


def test_hot_band_value(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    random.seed(5)
    start = random.getrandbits(64)
    # half the bits in common, so that whole bands are equal, and chains of small steps among them
    codes = {start ^ (random.getrandbits(32) & random.getrandbits(32) & random.getrandbits(32)) for _ in range(500)} | {random.getrandbits(64) for _ in range(50)}
    codes = sorted(codes)
    x = np.array(codes, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1))
    label = simhash.forest(len(x), near[:, 1], near[:, 0])
    df = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp long")
    place = {simhash.signed(c): i for i, c in enumerate(codes)}
    links = [(place[r.a], place[r.b]) for r in simhash.near_links(df).collect()]
    assert all(label[i] == label[j] for i, j in links)
    i, j = (np.array(side) for side in zip(*links))
    assert np.array_equal(simhash.forest(len(x), i, j), label) and len(set(label.tolist())) < len(codes)
    plan = simhash.near_links(df)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
