"""Quality rules as a bitmask ledger.

Every rule is evaluated once.  The ledger keeps the measurements and one bit per
failed rule, so that versioned policies (masks over the rules) and ablations (a policy
without one rule) are bitwise operations on a few distinct masks, not new scans.

Rules: a null text has no words, so every count is 0 and `too_few_words` fails.  Repeated
rows each get their own ledger row; other columns play no part, and kept ones named like a
measure or `failed` are replaced; texts of any length are measured whole; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import with_text_columns

SYMBOLS = b"#*$%&|<>"
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, n_bangs bigint, n_capitals bigint"
#: Rules by bit, each true where a document fails; in integers, so that any engine agrees.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "exclamation": "10 * n_bangs > 3 * n_words",
    "capitals": "100 * n_capitals > 40 * word_chars",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
    "too_many_words": "n_words > 100000",
}
#: Policy versions: the rules each enforces.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines"),
    "v2": tuple(r for r in RULES if r != "too_many_words"),  # length alone is measured, never a reason to drop
}


def mask_of(rules: Sequence[str]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - 2
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = np.unique(codes[:-1] * len(numbers) + codes[1:], return_inverse=True)[1]
    windows, counts = np.unique(pairs[:-1] * len(numbers) + codes[2:], return_inverse=True, return_counts=True)[1:]
    at = np.flatnonzero(counts[windows] > 1)
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The MEASURES of one whole text.  Words are runs without x20 and x09-x0D."""
    raw = text or b""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    packed = np.frombuffer(b"".join(words), np.uint8)
    counts = np.bincount(packed, minlength=256)
    return (
        len(words),
        int(len(packed) - counts[0x80:0xC0].sum()),
        int(sum(counts[c] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(counts[33]),
        int(counts[65:91].sum()),
    )


def with_measures(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    def compute():
        return lambda texts: list(zip(*map(measure, texts))) or [[]] * 8

    return with_text_columns(df, text, MEASURES, compute, keep)


def failure_bits() -> Column:
    """One bit per failed rule."""
    return reduce(Column.bitwiseOR, [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]).cast("bigint")


def ledger(df: DataFrame, text: str = "text", keep: Sequence[str] | None = ("doc_id",)) -> DataFrame:
    """Columns `keep`, the measurements and `failed` (the bits of the failed rules)."""
    return with_measures(df, text, keep).withColumn("failed", failure_bits())


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col(failed).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that pass without it."""
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask_of(POLICIES[policy]))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask_of([r])).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    spread = masks.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return spread.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared import table

    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base")).alias("base_failed"), passes("v2").alias("kept"), F.col("failed").alias("failed_rules"),
    )


def op2_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v2 costs alone, over the ledger of all documents."""
    from .shared import table

    return ablations(ledger(table(spark, sf_dir, "documents")), "v2")


WORD_SQL = r"[^\x20\x09-\x0D]+"
OP2_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_SQL}')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, t, ws, ls, len(ws) AS n_words,
         list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS gs
  FROM w
), e AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS i FROM g),
r AS (SELECT doc_id, i FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
p AS (SELECT DISTINCT doc_id, i + k AS word_no FROM r, (VALUES (0), (1), (2)) AS v(k)),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM p GROUP BY doc_id),
m AS (
  SELECT g.doc_id, n_words, len(array_to_string(ws, '')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs, len(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM g LEFT JOIN n USING (doc_id)
), f AS (
  SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values()))} AS failed_rules FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, (failed_rules & {mask_of(POLICIES["v2"])}) = 0 AS kept,
       failed_rules::BIGINT AS failed_rules
FROM f
"""
_EACH = ", ".join(f"('{r}', {mask_of([r])})" for r in POLICIES["v2"])
OP2_ABLATIONS_SQL = f"""
WITH masks AS (SELECT failed_rules & {mask_of(POLICIES["v2"])} AS bits FROM ({OP2_SQL})), r(rule, bit) AS (VALUES {_EACH})
SELECT rule, count_if(bits & bit <> 0)::BIGINT AS n_failed, count_if(bits = bit)::BIGINT AS n_failed_alone, count_if(bits & ~bit = 0)::BIGINT AS n_kept_without FROM masks, r GROUP BY rule
"""
