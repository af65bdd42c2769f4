"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

Shape of the job: one scan, no shuffle.  The JVM cuts texts into words; an Arrow step
takes documents in blocks of bounded size, finds the distinct words of a block, folds
the ranked merges over all their byte arrays at once (each round merges the
lowest-ranked, leftmost pair of every word that still has one) and puts the ids of the
documents together.  Memory does not grow with the input, and a lost executor costs
only its own blocks.  Decoding concatenates the binary pieces of the ids.

The classes of characters are tiktoken's own: the JVM's regular expressions know the letters and
digits of an older Unicode.  A text that holds a character of which the two disagree is put together
again from its pieces, the rest of the text included, and cut by tiktoken's table.

The merges were first written as Spark higher-order functions against a literal rank
table; README.md has the figures that led to this form.

Rules: a null text is the empty text (no ids, empty bytes).  Repeated rows and null
ids pass through unchanged, one output row per input row; other columns are dropped
unless named in `keep`, whatever their names; an empty table gives no rows.  A word longer than LONG_WORD bytes is merged with a heap,
n log n for any length; the ids are the same.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import give_back, named

#: Documents are taken until their words reach this many bytes.
BLOCK_BYTES = 8 << 20
LONG_WORD = 96
NO_PAIR = 2**31 - 1
PRIMES = (262_147, 262_151)


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one `base64(piece) rank` a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def default_ranks() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@dataclass
class Classes:
    """What tiktoken's regular expressions take each code point for, and where the JVM's differ."""

    stand_in: np.ndarray  # by code point: an ASCII character of the same class; ASCII stands for itself
    odd: np.ndarray  # by code point: whether the JVM's class is another
    first: int  # least first byte of an odd character

    def recut(self, text: bytes, pattern: regex.Pattern) -> list[bytes]:
        """Words of a text: the pattern is run over the stand-ins, of which every engine thinks alike."""
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        sizes = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        found = pattern.finditer(self.stand_in[points].tobytes().decode("ascii"))
        return [text[ends[a] : ends[b]] for a, b in (m.span() for m in found)]

    def has_odd(self, text: bytes) -> bool:
        return bool(self.odd[np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)].any())


#: Code points whose classes are asked for at once, which bounds what either engine holds of them.
POINTS = 0x4000


def classes_of(spark: SparkSession) -> Classes:
    """Both tables, by running each engine's classes over all code points, POINTS at a time."""
    single = {bytes([b]): b for b in range(256)}
    stand_in, odd = np.full(0x110000, ord("!"), np.uint8), np.zeros(0x110000, bool)
    # a letter that begins no contraction, a digit, and a blank other than the space
    for pattern, mark in ((r"\p{L}", "b"), (r"\p{N}", "0"), (r"\s", "\t")):
        mine, theirs = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}), spark._jvm.java.util.regex.Pattern.compile(f"(?U)[^{pattern}]")
        for first in range(0, 0x110000, POINTS):
            points = np.arange(first, first + POINTS, dtype=np.uint32)
            text = points[(points < 0xD800) | (points >= 0xE000)].tobytes().decode("utf-32-le")
            if not text:
                continue
            is_mine, is_theirs = np.zeros((2, POINTS), bool)
            for held, found in ((is_mine, bytes(mine.encode_ordinary(text)).decode()), (is_theirs, theirs.matcher(text).replaceAll(""))):
                held[np.frombuffer(found.encode("utf-32-le"), np.uint32) - first] = True
            stand_in[first : first + POINTS][is_mine] = ord(mark)
            odd[first : first + POINTS] |= is_mine != is_theirs
    stand_in[:0x80] = np.arange(0x80)
    least = int(odd.argmax())
    return Classes(stand_in, odd, chr(least).encode()[0] if odd.any() else 256)


class Merges:
    """The rank map as arrays: pair of ranks -> rank of the joined piece."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= 2**17 or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must cover all single bytes and stay below 131072")
        self.ranks = ranks
        self.vocabulary, self.ids = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int32)
        self.byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        by_rank = {rank: piece for piece, rank in ranks.items()}
        self.pieces = pa.array([by_rank.get(i, b"") for i in range(max(by_rank) + 1)], pa.binary())
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                left, right = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 17 | right] = rank
        order = np.array(sorted(pairs), np.int64)
        ranked = np.array([pairs[k] for k in order.tolist()], np.int32)
        # each key sits in the first table if its slot was free there, else in the second, else in the rest
        self.keys, self.values, left = [], [], np.arange(len(order))
        for prime in PRIMES:
            slots, first = np.unique(order[left] % prime, return_index=True)
            keys, values = np.full(prime, -1, np.int64), np.full(prime, NO_PAIR, np.int32)
            keys[slots], values[slots] = order[left[first]], ranked[left[first]]
            self.keys.append(keys)
            self.values.append(values)
            left = np.delete(left, first)
        self.rest_keys, self.rest_values = order[left], ranked[left]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 17 | right
        slot = key % PRIMES[0]
        out = np.where(self.keys[0][slot] == key, self.values[0][slot], NO_PAIR).astype(np.int32)
        at = np.flatnonzero(out == NO_PAIR)
        slot = key[at] % PRIMES[1]
        out[at] = np.where(self.keys[1][slot] == key[at], self.values[1][slot], NO_PAIR)
        if len(self.rest_keys):
            at = at[out[at] == NO_PAIR]
            near = np.minimum(np.searchsorted(self.rest_keys, key[at]), len(self.rest_keys) - 1)
            out[at] = np.where(self.rest_keys[near] == key[at], self.rest_values[near], NO_PAIR)
        return out

    def fold(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as runs of byte ranks (no empty word) -> runs of token ids and their sizes."""
        done_ids, done_sizes, done_words = [], [], []
        words = np.arange(len(sizes))
        ranks = np.empty(len(ids), np.int32)
        ranks[:-1] = self.rank(ids[:-1], ids[1:])
        ranks[np.cumsum(sizes) - 1] = NO_PAIR
        while len(words):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            live = least < NO_PAIR
            if not live.all():
                spread = np.repeat(live, sizes)
                done_ids.append(ids[~spread])
                done_sizes.append(sizes[~live])
                done_words.append(words[~live])
                ids, ranks, sizes, words, least = ids[spread], ranks[spread], sizes[live], words[live], least[live]
                if not len(words):
                    break
            owner = np.repeat(np.arange(len(sizes)), sizes)
            hits = np.flatnonzero(ranks == least[owner])
            at = hits[np.concatenate([[True], owner[hits[1:]] != owner[hits[:-1]]])]  # leftmost of each word
            ids[at] = least
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, ranks, sizes = ids[keep], ranks[keep], sizes - 1
            at -= np.arange(len(at))
            ends = np.cumsum(sizes)
            last = at == ends - 1
            ranks[at] = NO_PAIR
            ranks[at[~last]] = self.rank(ids[at[~last]], ids[at[~last] + 1])
            inner = at[at > ends - sizes]
            ranks[inner - 1] = self.rank(ids[inner - 1], ids[inner])
        if not done_words:
            return ids, sizes
        order = np.argsort(np.concatenate(done_words), kind="stable")
        ids, sizes = np.concatenate(done_ids), np.concatenate(done_sizes)
        starts = np.cumsum(sizes) - sizes
        return ids[runs(starts[order], sizes[order])], sizes[order]

    def encode_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words -> (ids of all words in a row, number of ids of each)."""
        offsets, raw = binary_parts(words)
        sizes = np.diff(offsets)
        whole = pc.fill_null(pc.index_in(words, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False)
        short = np.flatnonzero((whole < 0) & (sizes <= LONG_WORD) & (sizes > 0))
        counts = (whole >= 0).astype(np.int64)
        folded, counts[short] = self.fold(self.byte_ranks[raw[runs(offsets[short], sizes[short])]], sizes[short])
        long = {int(i): merge_long(words[int(i)].as_py(), self.ranks) for i in np.flatnonzero((whole < 0) & (sizes > LONG_WORD))}
        for i, ids in long.items():
            counts[i] = len(ids)
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[starts[whole >= 0]] = self.ids[whole[whole >= 0]]
        out[runs(starts[short], counts[short])] = folded
        for i, ids in long.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, counts


def binary_parts(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a binary array without nulls."""
    if not len(values):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], raw


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list: n log n for words of any length."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != stop:
            continue
        alive[j], after[i] = False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (rank := ranks.get(word[k : after[after[k]]])) is not None:
                heapq.heappush(heap, (rank, k, after[after[k]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of batches whose word column `at` comes to BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            held.append(part)
            size += part.column(at).nbytes
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def settled(lists: pa.ListArray, classes: Classes, pattern: regex.Pattern) -> pa.ListArray:
    """The JVM's words of each text, cut anew where a text holds a character the JVM takes for another."""
    words = lists.flatten().cast(pa.binary())
    ends, raw = binary_parts(words)
    if not len(raw) or raw.max() < classes.first:
        return pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), words)
    bounds = np.asarray(lists.offsets).astype(np.int64)
    bounds -= bounds[0]
    high = np.concatenate([[0], np.cumsum(raw >= classes.first)])
    suspects = np.flatnonzero(high[ends[bounds[1:]]] > high[ends[bounds[:-1]]])
    anew = {}
    for i in suspects.tolist():
        text = raw[ends[bounds[i]] : ends[bounds[i + 1]]].tobytes()
        if classes.has_odd(text):
            anew[i] = classes.recut(text, pattern)
    if not anew:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words)
    pieces, sizes, done = [], np.diff(bounds), 0
    for i, own in anew.items():
        pieces += [words.slice(bounds[done], bounds[i] - bounds[done]), pa.array(own, pa.binary())]
        sizes[i], done = len(own), i + 1
    pieces.append(words.slice(bounds[done]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.concat_arrays(pieces))


def _encoder(merges: Merges, keep: int, names: list[str], classes: Classes, pattern: str, finish=lambda ids, offsets, _: [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]):
    """Arrow step: `keep` columns and a column of word lists -> the kept columns and what `finish` makes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = regex.compile(pattern)
        for held in _blocks(batches, keep):
            lists = [settled(b.column(keep), classes, cut) for b in held]
            coded = pc.dictionary_encode(pa.concat_arrays([x.flatten() for x in lists]))
            values, sizes = merges.encode_words(coded.dictionary)
            starts, each, done = np.cumsum(sizes) - sizes, np.asarray(coded.indices), 0
            for batch, x in zip(held, lists):
                ends = np.asarray(x.offsets).astype(np.int64)
                mine = each[done : done + ends[-1]]
                done += ends[-1]
                bounds = np.concatenate([[0], np.cumsum(sizes[mine])])[ends].astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), *finish(values[runs(starts[mine], sizes[mine])], bounds, merges)], names=names)

    return run


def _cut(df: DataFrame, text: str, keep: Sequence[str], pattern: str) -> DataFrame:
    """Kept columns as k0, k1, ... and the words of each whole text."""
    words = F.regexp_extract_all(F.coalesce(named(text), F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    return df.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keep)], words.alias("words"))


def encode(df: DataFrame, text: str, keep: Sequence[str], ranks: dict[bytes, int], pattern: str, into: str = "ids") -> DataFrame:
    """Columns `keep` plus `into` array<int>: the ids of each whole text, without special tokens."""
    cut = _cut(df, text, keep, pattern)
    schema = T.StructType([*cut.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    out = cut.mapInArrow(_encoder(Merges(ranks), len(keep), schema.names, classes_of(df.sparkSession), pattern), schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("ids").alias(into))


def decode(df: DataFrame, ids: str, keep: Sequence[str], ranks: dict[bytes, int], into: str = "bytes") -> DataFrame:
    """Columns `keep` plus `into` binary: the pieces of the ids one after another; a null list gives null.

    An id outside the vocabulary fails the job, as it has no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in ranks.items()}
        for batch in batches:
            out = [None if x.values is None else b"".join(map(pieces.__getitem__, x.values.to_pylist())) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], names=schema.names)

    cut = df.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keep)], named(ids).alias("ids"))
    schema = T.StructType([*cut.schema.fields[:-1], T.StructField("bytes", T.BinaryType())])
    out = cut.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], F.col("bytes").alias(into))


def encoded_digests(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Encode, decode the ids again, and digest both: n_tokens, ids_sha256, decoded_sha256.

    The digests are taken where the ids are made, so that the ids need not travel."""
    ranks, pattern = default_ranks()
    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def finish(ids: np.ndarray, offsets: np.ndarray, merges: Merges) -> list[pa.Array]:
        plain, pieces = ids.astype("<u4"), merges.pieces.take(pa.array(ids))
        ends, raw = binary_parts(pieces)
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        return [pa.array(np.diff(offsets).astype(np.int64)), pa.array([hexed(plain[a:b]) for a, b in spans]), pa.array([hexed(raw[ends[a] : ends[b]]) for a, b in spans])]

    cut = _cut(df, text, keep, pattern)
    schema = T.StructType([*cut.schema.fields[:-1], *T.StructType.fromDDL(made).fields])
    out = cut.mapInArrow(_encoder(Merges(ranks), len(keep), schema.names, classes_of(df.sparkSession), pattern, finish), schema)
    give_back()
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "n_tokens", "ids_sha256", "decoded_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    return encoded_digests(table(spark, sf_dir, "documents"))
