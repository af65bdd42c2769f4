"""Language identification by language-bitmask n-gram filters.

A Bloom filter of n-grams is kept per language, but bit-sliced: a cell holds one bit
per language, so that AND-ing an n-gram's cells gives at once all languages that contain
it.  A text's n-grams are counted by mask; the popcount of each language is corrected
for that language's false-positive rate, and the largest decides.

Learning reads a bounded sample of whole labelled documents (about SAMPLE per language, and of more
than four languages about 4 * SAMPLE in all) and keeps every n-gram of it.  The filter has as many
cells as the language of most n-grams needs for a false-positive rate of FALSE, known before it is
built.  Scoring is one scan over whole texts.

Rules: a null text or one without a letter is `und` with score 0; a text with letters
but without any known n-gram gets the first learned language in name order and score
1 / languages; of equal counts (to a millionth) the language of more learnable documents wins, then the
first in name order: short texts often hold only n-grams that every language has.  Rows with null lang, text or
doc_id are not learned from.  More than LANGS languages are refused.  Repeated rows are
scored alike; an empty table gives no rows; other columns play no part, and kept ones named
like a new column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_part, table, with_text_columns

#: Sampled documents per language, and the highest false-positive rate of a language.
SAMPLE, FALSE = 2_000, 0.01
GRAM, HASHES = 4, 3
#: Languages that may be learned; the filter has a bit a cell for each, so more are refused.
LANGS = 1_000
NOT_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams_of(text: bytes | None) -> np.ndarray:
    """Every n-gram of the small letters of a whole text as one 64-bit code.

    ASCII that is not a letter is a gap and a run of gaps is one; the code points of an
    n-gram (at most 21 bits each, folded to 16) are packed side by side."""
    line = b" ".join((text or b"").translate(NOT_LETTERS).split())
    if not line:
        return np.zeros(0, np.uint64)
    points = np.frombuffer((" " + line.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    points = (points ^ (points >> np.uint64(16))) & np.uint64(0xFFFF)
    if len(points) < GRAM:
        points = np.concatenate([points, np.full(GRAM - len(points), 32, np.uint64)])
    code = points[: len(points) - GRAM + 1].copy()
    for k in range(1, GRAM):
        code <<= np.uint64(16)
        code |= points[k : len(points) - GRAM + 1 + k]
    return code


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace") if c > "\x7f") or text.upper() != text.lower()


def cells_of(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The HASHES cells of each code among 2^bits: multiplicative hashing, high bits."""
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)[:HASHES]
    return [((codes * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in odd]


@dataclass
class Filter:
    langs: list[str]
    bits: int  # 2^bits cells
    cells: np.ndarray  # cells x words of 8 languages
    false: np.ndarray  # false-positive rate of each language
    sizes: np.ndarray  # learnable documents of each language: decides between equal counts

    @classmethod
    def build(cls, grams: dict[str, np.ndarray], sizes: Mapping[str, int] | None = None) -> Filter:
        langs = sorted(grams)
        needed = max((len(x) for x in grams.values()), default=0) * HASHES / -math.log(1 - FALSE ** (1 / HASHES))
        bits = max(10, math.ceil(math.log2(max(needed, 1))))
        cells = np.zeros((1 << bits, max(1, -(-len(langs) // 8))), np.uint8)
        for i, lang in enumerate(langs):
            for at in cells_of(grams[lang], bits):
                cells[at, i // 8] |= np.uint8(1 << i % 8)
        filled = np.array([(cells[:, i // 8] >> (i % 8) & 1).mean() for i in range(len(langs))])
        return cls(langs, bits, cells, filled**HASHES, np.array([(sizes or {}).get(x, 0) for x in langs], np.int64))

    def counts(self, text: bytes | None) -> tuple[np.ndarray, int]:
        """Corrected number of the text's n-grams in each language, and the number of n-grams."""
        codes = grams_of(text)
        found = np.zeros(len(self.langs))
        at = cells_of(codes, self.bits)
        for word in range(self.cells.shape[1]):
            slices = self.cells[:, word]
            mask = slices[at[0]]
            for more in at[1:]:
                mask = mask & slices[more]
            by_mask = np.bincount(mask, minlength=256)
            for i in range(word * 8, min(word * 8 + 8, len(self.langs))):
                found[i] = by_mask[(np.arange(256) >> i % 8 & 1) == 1].sum()
        return np.clip((found - self.false * len(codes)) / (1 - self.false), 0, None), len(codes)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        counts, _ = self.counts(text)
        total = counts.sum()
        if not total:
            return self.langs[0], 1 / len(self.langs)
        whole = np.rint(counts * 1e6)
        best = int(np.lexsort((np.arange(len(whole)), -self.sizes, -whole))[0])
        return self.langs[best], float(counts[best] / total)


def fit(documents: DataFrame, sample: int = SAMPLE) -> Filter:
    """Learn the filter from text and lang of about `sample` documents per language, four times as many in all."""
    rows = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_part("doc_id", 4) != 2))
    # counted without reading texts; a row a language, so that the counts may go to all tasks
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGS + 1).collect()
    if len(sizes) > LANGS:
        raise ValueError(f"more than {LANGS} languages: the filter would not stay bounded")
    counted = documents.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in sizes], "lang string, n bigint")
    sample = min(sample, max(1, 4 * sample // max(1, len(sizes))))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1_000_000))
    chosen = rows.select("doc_id", "lang", "text").join(F.broadcast(counted), "lang").filter(F.col("text").isNotNull() & (chance < F.lit(1_000_000.0) * sample / F.col("n"))).select("lang", "text")

    def distinct(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                codes = np.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64))], names=["lang", "code"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(grams_of(text))
                size += len(text)
                if size > 1 << 24:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    # bounded by the sample; a code takes eight bytes on its way to the driver
    made = chosen.mapInArrow(distinct, "lang string, code bigint").distinct().toArrow()
    langs, codes = made.column("lang").combine_chunks(), made.column("code").to_numpy()
    coded = pc.dictionary_encode(langs)
    numbers = np.asarray(coded.indices)
    return Filter.build({lang: codes[numbers == i].view(np.uint64) for i, lang in enumerate(coded.dictionary.to_pylist())}, {r["lang"]: r["n"] for r in sizes})


def identify(documents: DataFrame, model: Filter, text: str = "text", keep: Sequence[str] | None = ("doc_id",)) -> DataFrame:
    """Columns `keep` plus lang_pred and score."""

    def compute():
        return lambda texts: list(zip(*[model.predict(x) for x in texts])) or [[], []]

    return with_text_columns(documents, text, "lang_pred string, score double", compute, keep)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = identify(documents, fit(documents))
    return out.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
