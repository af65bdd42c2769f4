"""Pfair mixing against a plain earliest-deadline-first schedule on the true weights."""

import collections
import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing


def plain_edf(weights, blocks):
    """Sources in slot order, phase by phase, and the largest deviation from the targets at any slot of any phase."""
    left, out, worst = dict(blocks), [], Fraction(0)
    while any(left.values()):
        now = {s: Fraction(str(weights[s])) for s in sorted(left) if left[s]}
        share = {s: w / sum(now.values()) for s, w in now.items()}
        run = collections.Counter()
        for slot in range(sum(left.values())):
            ready = [(math.ceil((run[s] + 1) / w), s) for s, w in share.items() if math.floor(run[s] / w) <= slot]
            s = min(ready)[1]
            run[s] += 1
            left[s] -= 1
            out.append(s)
            worst = max([worst, *(abs(run[x] - w * (slot + 1)) for x, w in share.items())])
            if not left[s]:
                break
    return out, worst


def table_of(spark, sizes):
    parts = [spark.range(n).select((F.col("id") + at).alias("doc_id"), F.lit(s).alias("source")) for at, (s, n) in zip(range(0, 10**9, 10**7), sizes.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@pytest.mark.parametrize(
    ("weights", "blocks"),
    [
        ({"a": 0.7, "b": 0.2, "c": 0.1}, {"a": 1000, "b": 225, "c": 75}),
        ({"a": 0.12345, "b": 0.87655}, {"a": 900, "b": 7000}),
        ({"a": 0.00012, "b": 0.12345, "c": 0.87643}, {"a": 7, "b": 2100, "c": 14000}),
        ({"a": Fraction(1, 3), "b": Fraction(1, 7), "c": Fraction(11, 21)}, {"a": 500, "b": 500, "c": 500}),
    ],
)
def test_schedule_on_true_weights(spark, weights, blocks):
    """Slot for slot the plain schedule, in every phase; never a block away from the target."""
    out = mixing.mix(table_of(spark, blocks), weights=weights, block_rows=1).collect()
    got = [r.source for r in sorted(out, key=lambda r: r.mix_slot)]
    want, worst = plain_edf(weights, blocks)
    assert sorted(r.mix_slot for r in out) == list(range(len(out))) and got == want and worst < 1


def test_many_blocks_of_a_small_weight(spark):
    """100,000 blocks, several times around where the cycle is short, once where it is not."""
    weights = {"a": 0.00012, "b": 0.12345, "c": 0.87643}
    out = mixing.mix(table_of(spark, {"a": 12, "b": 12345, "c": 87643}), weights=weights, block_rows=1).select("source", "mix_slot").toPandas().sort_values("mix_slot")
    assert (out["mix_slot"].to_numpy() == range(100_000)).all()
    for s, w in weights.items():
        run = (out["source"] == s).cumsum().to_numpy()
        assert abs(run - w * (1 + out["mix_slot"].to_numpy())).max() < 1


def test_default_targets_are_whole_shares(spark):
    """By size to a power: deviation below one from the stated shares, over many cycles of a small grid."""
    blocks = {"a": 900, "b": 100, "c": 25}
    out = mixing.mix(table_of(spark, blocks), block_rows=1, grid=45).collect()
    want, worst = plain_edf({"a": 30, "b": 10, "c": 5}, blocks)
    assert [r.source for r in sorted(out, key=lambda r: r.mix_slot)] == want and worst < 1


def test_weights_that_do_not_repeat_are_refused(spark):
    with pytest.raises(ValueError, match="repeat"):
        mixing.exact_shares({"a": 0.123456789, "b": 1.0})
    with pytest.raises(ValueError, match="0 or more"):
        mixing.exact_shares({"a": -1.0, "b": 1.0})
    assert mixing.exact_shares({"a": 1 / 3, "b": 2 / 3, "c": 0}) == {"a": 1, "b": 2, "c": 0}


def test_edges(spark):
    """Null sources, sources without weight, clashing names, repeated rows, empty tables, equal keys, maps."""
    sizes = {"a": 400, "b": 90, "c": 30, None: 7}
    df = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    own = ["row", "source_", "n", "h", "key", "part", "size", "start", "r", "tie", "block", "runs", "slot", "_n", "_part", "_h", "_k", "mix_block"]
    df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(own)], F.create_map(F.lit("k"), F.lit(1)).alias("some map"))
    out = mixing.mix(df, weights={"a": 0.5, "b": 0.5}, block_rows=4, part_rows=100)
    assert out.columns == [c for c in df.columns if c != "mix_block"] + ["mix_block", "mix_slot", "mix_position"]
    rows = out.collect()
    assert len(rows) == 527 and len({r.mix_position for r in rows}) == 527
    assert all(getattr(r, c) == i for r in rows for i, c in enumerate(own) if c != "mix_block")
    ends = {s: (min(r.mix_slot for r in rows if r.source == s), max(r.mix_slot for r in rows if r.source == s)) for s in sizes}
    assert max(ends["a"][1], ends["b"][1]) < ends[None][0] <= ends[None][1] < ends["c"][0]
    assert mixing.mix(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a", i % 3) for i in range(60)], "doc_id long, source string, x int")
    ordered = lambda d: [r.x for r in mixing.mix(d, block_rows=2).orderBy("mix_position").collect()]
    assert ordered(same) == ordered(same.repartition(5)) and sorted(ordered(same)) == sorted(i % 3 for i in range(60))
