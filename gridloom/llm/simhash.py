"""SimHash fingerprints and exact near-duplicate components by a Gray-order hierarchical index.

1. Fingerprint every text (Arrow step, no shuffle); equal fingerprints are grouped
   first, so copies never meet each other as rows.
2. Two fingerprints with at most `bits` differing bits agree on one of some masks
   (`bits + 1` bands, or combinations of more and narrower ones in large tables).  Each
   fingerprint is dealt once per mask; rows are range-partitioned by (mask, value, Gray
   rank), so even a hot value is spread over tasks, and cut into chunks of bounded size.
3. A chunk is a tree: codes are sorted by Gray rank, each node holds the masked bit
   pattern that its codes share.  Two nodes are compared by adding the differences
   of the bits first fixed at their level to those found above; groups beyond `bits`
   are dropped whole, and only code pairs within `bits` remain.
4. Chunks of one band value are compared pairwise unless their root patterns already
   differ by more than `bits`.
5. Each comparison yields a spanning forest of its links rather than all pairs, and
   the forests are joined to components by label propagation with pointer jumping.

Rules: null and wordless texts have fingerprint zero, linked like any other; texts of any
length are read whole; repeated rows and ids each get a row; a component of null ids only
has a null id; an empty table gives no rows.  Other columns play no part, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, with_text_columns

WIDTH = 64
CHUNK = 2048  # codes in a chunk of the index
FANOUT = 8  # children of an index node
FULL = np.uint64(2**64 - 1)

BYTE_BITS = ((np.arange(256, dtype=np.uint16)[:, None] >> np.arange(8)) & 1).astype(np.uint16)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of every word shingle, a shorter text being one; none of a wordless text.

    On UTF-8 bytes, lower() changes A-Z only and split() cuts at x20 and x09-x0D only."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    raw = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(raw)]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist())], np.uint64)


def code_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > len(hashes)).tolist()))


def fingerprint_text(text: bytes | None, shingle: int = 4) -> int:
    """The code of the text's word shingles; 0 of a wordless text."""
    hashes = shingle_hashes(text, shingle)
    return code_of(hashes) if len(hashes) else 0


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] | None = ("doc_id",), shingle: int = 4, into: str = "fp") -> DataFrame:
    """Columns `keep` (None: all) plus `into`, a bigint that holds the 64 bits."""

    def compute():
        return lambda texts: [np.array([fingerprint_text(x, shingle) for x in texts], np.uint64).view(np.int64)]

    return with_text_columns(df, text, f"`{into}` bigint", compute, keep)


def gray_rank(code: Column) -> Column:
    """Position of a bit string in the reflected Gray order, as a bigint that sorts like the unsigned rank."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(2**63)))


def band_masks(bits: int, codes: int) -> list[int]:
    """Masks of which two fingerprints within `bits` agree on at least one.

    The fingerprint is cut into `bits + c` pieces, and c of them make a mask: at most
    `bits` pieces differ, so some c agree.  With c = 1 a mask has 64 / (bits + 1) bits; c
    grows until a mask value holds no more than a chunk of `codes` codes spread evenly, so that the
    work of a value does not grow with the table.  Links are the same for every c."""
    c = 1
    while codes > CHUNK << (WIDTH * c // (bits + c)) and c < WIDTH - bits:
        c += 1
    cuts = [round(WIDTH * i / (bits + c)) for i in range(bits + c + 1)]
    pieces = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(pieces, c)]


def signed(code: int) -> int:
    return code - 2**64 if code >= 2**63 else code


class Tree:
    """Index over codes in Gray order; level 0 is the codes, each level above groups FANOUT nodes."""

    def __init__(self, codes: np.ndarray):
        self.masks, self.patterns = [np.full(len(codes), FULL)], [codes]
        while len(self.masks[-1]) > 1:
            masks, patterns = self.masks[-1], self.patterns[-1]
            at = np.arange(0, len(masks), FANOUT)
            ones, zeros = np.bitwise_and.reduceat(patterns & masks, at), np.bitwise_and.reduceat(~patterns & masks, at)
            self.masks.append(ones | zeros)
            self.patterns.append(ones)

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        k = min(k, len(self.masks) - 1)
        return self.masks[k], self.patterns[k]


def near_pairs(a: Tree, b: Tree, bits: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all code pairs within `bits`; i < j if both trees are the same."""
    top = max(len(a.masks), len(b.masks)) - 1
    i = j = np.zeros(1, np.int64)
    fixed, found = np.zeros(1, np.uint64), np.zeros(1, np.int64)
    for k in range(top, -1, -1):
        if k < top:

            def children(nodes: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
                if k + 1 > len(tree.masks) - 1:  # this tree is lower: its root stays
                    return nodes, np.ones(len(nodes), np.int64)
                first = nodes * FANOUT
                return first, np.minimum(FANOUT, len(tree.masks[k]) - first)

            first_i, n_i = children(i, a)
            first_j, n_j = children(j, b)
            each = n_i * n_j
            at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            width = np.repeat(n_j, each)
            i, j = np.repeat(first_i, each) + at // width, np.repeat(first_j, each) + at % width
            fixed, found = np.repeat(fixed, each), np.repeat(found, each)
            if same:
                keep = i <= j if k else i < j
                i, j, fixed, found = i[keep], j[keep], fixed[keep], found[keep]
        (mask_a, code_a), (mask_b, code_b) = a.level(k), b.level(k)
        both = mask_a[i] & mask_b[j]
        found = found + np.bitwise_count((code_a[i] ^ code_b[j]) & both & ~fixed)
        keep = found <= bits
        i, j, fixed, found = i[keep], j[keep], both[keep], found[keep]
    if top == 0 and same:
        return i[:0], j[:0]
    return i, j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component under the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _links(codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    label = forest(len(codes), i, j)
    at = np.flatnonzero(label != np.arange(len(codes)))
    return pa.RecordBatch.from_arrays([pa.array(codes[at].view(np.int64)), pa.array(codes[label[at]].view(np.int64))], names=["a", "b"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, value, fp) in order -> a row a chunk, with the pattern its codes share."""

    def out(chunks: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.cumsum([0, *(len(c[2]) for c in chunks)]).astype(np.int32)
        codes = np.concatenate([c[2] for c in chunks])
        ones, zeros = np.bitwise_and.reduceat(codes, sizes[:-1]), np.bitwise_and.reduceat(~codes, sizes[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array([c[0] for c in chunks], pa.int32()), pa.array([c[1] for c in chunks], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(codes.view(np.int64))), pa.array((ones | zeros).view(np.int64)), pa.array(ones.view(np.int64))],
            names=["band", "value", "codes", "mask", "pattern"],
        )

    key, rest, ready, size = None, np.zeros(0, np.uint64), [], 0
    for batch in batches:
        band, value = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        codes = np.asarray(batch.column(2)).view(np.uint64)
        cuts = np.flatnonzero((np.diff(band) != 0) | (np.diff(value) != 0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(codes)]):
            if hi == lo:
                continue
            now = (int(band[lo]), int(value[lo]))
            if now != key:
                if len(rest):
                    ready.append((*key, rest))
                key, rest = now, np.zeros(0, np.uint64)
            rest = np.concatenate([rest, codes[lo:hi]])
            while len(rest) >= CHUNK:
                ready.append((*key, rest[:CHUNK]))
                rest = rest[CHUNK:]
            size += hi - lo
        if size >= 65536 and ready:
            yield out(ready)
            ready, size = [], 0
    if len(rest):
        ready.append((*key, rest))
    if ready:
        yield out(ready)


def _inside(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for codes in batch.column(0):
                x = np.asarray(codes.values).view(np.uint64)
                if len(x) > 1:
                    tree = Tree(x)
                    held.append(_links(x, *near_pairs(tree, tree, bits, True)))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([h.column(k) for h in held] or [pa.array([], pa.int64())]) for k in range(2)], names=["a", "b"])

    return run


def _across(bits: int):
    """Rows (chunk, codes, chunk, codes) with those of a second chunk in a row: its tree is built once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, y = None, None, None
        for batch in batches:
            for left, chunk, right in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                if chunk != held:
                    held, y = chunk, np.asarray(right.values).view(np.uint64).copy()
                    tree = Tree(y)
                x = np.asarray(left.values).view(np.uint64)
                i, j = near_pairs(Tree(x), tree, bits, False)
                yield _links(np.concatenate([x, y]), i, j + len(x))

    return run


def near_links(codes: DataFrame, bits: int = 4) -> DataFrame:
    """Distinct codes (`fp`) -> (a, b): links whose components are those of all pairs within `bits`.

    `codes` is read twice and should be a written table."""
    parts = [F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("bigint")).alias("value")) for k, mask in enumerate(band_masks(bits, codes.count()))]
    dealt = codes.select("fp", F.explode(F.array(*parts)).alias("p")).select("p.band", "p.value", "fp", gray_rank(F.col("fp")).alias("rank"))
    ordered = dealt.repartitionByRange("band", "value", "rank").sortWithinPartitions("band", "value", "rank").select("band", "value", "fp")
    chunks = materialise(ordered.mapInArrow(_chunks, "band int, value bigint, codes array<bigint>, mask bigint, pattern bigint").withColumn("chunk", F.monotonically_increasing_id()))
    inside = chunks.filter(F.size("codes") > 1).select("codes").mapInArrow(_inside(bits), "a bigint, b bigint")
    many = chunks.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").select("band", "value")
    # chunks of one value are compared by the patterns they share; only pairs that may hold neighbours fetch their codes
    split = chunks.select("band", "value", "mask", "pattern", "chunk").join(many, ["band", "value"], "left_semi")
    left, right = (split.select("band", "value", *[F.col(c).alias(f"{c}_{side}") for c in ("mask", "pattern", "chunk")]) for side in "xy")
    shared = F.col("mask_x").bitwiseAND(F.col("mask_y"))
    pairs = left.join(right, ["band", "value"]).filter((F.col("chunk_x") < F.col("chunk_y")) & (F.bit_count(F.col("pattern_x").bitwiseXOR(F.col("pattern_y")).bitwiseAND(shared)) <= bits)).select("chunk_x", "chunk_y")
    codes_of = lambda side: chunks.select(F.col("chunk").alias(f"chunk_{side}"), F.col("codes").alias(f"codes_{side}"))
    met = pairs.join(codes_of("x"), "chunk_x").join(codes_of("y"), "chunk_y").sortWithinPartitions("chunk_y")
    across = met.select("chunk_x", "codes_x", "chunk_y", "codes_y").mapInArrow(_across(bits), "a bigint, b bigint")
    return inside.unionByName(across)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) between bigints -> (node, label), both hashed: xxhash64 of a node, and one label a component.

    Each round gives every node the smallest label among its own and its neighbours'
    and then jumps to that label's label; links become links between labels.  Nodes
    are compared by their hash, which is one to one on bigints: in a random order a
    constant share of the nodes falls away each round, so rounds grow with the logarithm of
    the number of nodes, also along chains of neighbouring numbers."""
    links = links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    links = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    steps = []
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("low")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("low")))
        low = both.groupBy("node").agg(F.min("low").alias("low")).select("node", F.least("node", "low").alias("low"))
        jump = low.alias("x").join(low.alias("y"), F.col("x.low") == F.col("y.node"), "left").select(F.col("x.node").alias("node"), F.coalesce("y.low", "x.low").alias("low"))
        jump = materialise(jump)
        steps.append(jump)
        moved = links.join(jump.select(F.col("node").alias("a"), F.col("low").alias("la")), "a").join(jump.select(F.col("node").alias("b"), F.col("low").alias("lb")), "b")
        links = materialise(moved.filter("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    # the nodes of a step are labels of the step before, so each table stands in the plan once
    out = steps[-1].select("node", F.col("low").alias("label"))
    for step in reversed(steps[:-1]):
        out = step.join(out.select(F.col("node").alias("low"), "label"), "low", "left").select("node", F.coalesce("label", "low").alias("label"))
    return out


def with_components(marked: DataFrame, bits: int = 4) -> DataFrame:
    """(doc_id, fp) -> plus component_id: the smallest doc_id reachable over links of at most `bits`.

    `marked` should be a written table.  Null ids never name a component; a component
    of null ids only has a null id."""
    codes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(codes, bits))
    hashed = codes.withColumn("node", F.xxhash64("fp"))
    labels = hashed.join(linked, "node", "left").select("fp", "least", F.coalesce("label", "node").alias("label"))
    labels = materialise(labels)
    # a written table of the components of several codes: both sides of the join are then plain
    # exchanges, of which Spark can split a hot label's partition
    several = materialise(labels.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n")).filter("n > 1").select("label", "component_id", F.lit(True).alias("several")))
    named = labels.join(several, "label", "left").select("fp", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return marked.join(named, "fp", "left")


def near_duplicates(df: DataFrame, text: str = "text", bits: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id for every row; nulls and wordless texts have fingerprint zero."""
    marked = materialise(fingerprints(df, text, shingle=shingle))
    return with_components(marked, bits).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return near_duplicates(table(spark, sf_dir, "documents"))
