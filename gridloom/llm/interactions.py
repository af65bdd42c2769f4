"""Filter interaction audit: what every filter removes in every order of the filters.

1. One scan gives each document a bit per filter whose condition it fails.  Whether a text is a
   copy of one with a smaller id is told by digests, never by moving texts.
2. Documents are counted by (part, mask of failed filters): the mask cells.
3. A recursive CTE begins with the empty prefix at each possible mask and extends it by one
   unused letter a level, carrying the bits applied so far; each level says what its step
   does to the mask's documents.  It depends on the number of filters only (10,432 rows for
   five), so it is broadcast to the mask cells, whose counts are summed per part and prefix.
4. An order's step is the prefix of that length; the Shapley sum weighs each prefix by the
   orders that begin with it.

Rules: a null text is empty; a null source is the part ''.  A row without doc_id is counted but is
neither a copy nor an original; rows of the smallest id of a text are all originals, also when the id
repeats.  Of repeated labels any quality 1 and any toxic 1 counts.  Repeated rows count each; other
columns, whatever their names, are not read; texts of any length are measured whole; an empty
table gives no rows, a table without labels lost counts of zero.
"""

from __future__ import annotations

from hashlib import sha256
from math import factorial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, named, table, with_text_columns

#: Filters A to D are decided by a text alone, E over the whole table.
LETTERS = "ABCDE"
CAPITALS, SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(0x80, 0xC0))
#: The steps of six filters stay within Spark's limit of rows of a recursion; seven would not.
MOST_FILTERS = 6


def text_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a whole text fails; `split` of bytes cuts at x20 and x09-x0D only."""
    words, others = raw.split(), lambda some: len(raw) - len(raw.translate(None, some))
    failed = (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * others(CAPITALS) > 2 * (len(raw) - others(INNER)),
        others(SYMBOLS) > 0,
    )
    return sum(1 << i for i, x in enumerate(failed) if x)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of each row, with the bits of A to D."""

    def compute():
        return lambda texts: ([text_mask(t or b"") for t in texts], [sha256(t or b"").digest() for t in texts])

    cut = docs.select(named("doc_id").alias("doc_id"), F.coalesce(named("source"), F.lit("")).alias("part"), named("text").alias("text"))
    return with_text_columns(cut, "text", "mask int, digest binary", compute, ["doc_id", "part"])


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents by the filters they fail.

    Rows are counted by id first and by digest then, both before they are shuffled to one place, so
    copies of a text meet as one row a part and label, however many they are."""
    marks = labels.filter(named("doc_id").isNotNull()).groupBy(named("doc_id").alias("doc_id")).agg(
        F.max((named("quality") == 1).cast("int")).alias("good"), F.max((named("toxic") == 1).cast("int")).alias("toxic"))
    # rows without id match no label: spread over the partitions they come from
    spread = F.when(F.col("doc_id").isNull(), 1 + F.spark_partition_id()).otherwise(0)
    rows = failures(docs).withColumn("spread", spread).join(marks.withColumn("spread", F.lit(0)), ["doc_id", "spread"], "left")
    same = ["digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")]
    by_id = rows.groupBy("doc_id", "spread", *same).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    texts = by_id.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("no_id")).agg(F.sum("n").alias("n"), first.alias("first"))
    # a text has as many rows here as parts and labels, not as copies
    met = texts.withColumn("original", F.min("first.doc_id").over(Window.partitionBy("digest")))
    passing = F.when(F.col("no_id"), F.col("n")).when(F.col("first.doc_id") == F.col("original"), F.col("first.n")).otherwise(0)
    split = F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))
    cells = met.withColumn("passing", passing).select("part", "good", "toxic", F.inline(split)).filter("n > 0")
    return cells.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


#: One row a prefix and mask.  `applied` holds the bits of the letters before the last, `bit` that of the last.
STEPS = """
WITH RECURSIVE filters AS (SELECT substr('{letters}', id + 1, 1) AS letter, 1 << id AS bit FROM (SELECT CAST(id AS INT) AS id FROM range({count}))),
masks AS (SELECT CAST(id AS INT) AS mask FROM range({masks})),
steps(prefix, step, applied, bit, mask, kept, removed, redundant, alone) AS (
  SELECT '', 0, 0, 0, mask, true, false, false, false FROM masks
  UNION ALL
  SELECT concat(s.prefix, f.letter), s.step + 1, s.applied | s.bit, f.bit, s.mask,
         (s.mask & (s.applied | s.bit | f.bit)) = 0,
         (s.mask & f.bit) <> 0 AND (s.mask & (s.applied | s.bit)) = 0,
         (s.mask & f.bit) <> 0 AND (s.mask & (s.applied | s.bit)) <> 0,
         s.mask = f.bit
  FROM steps s JOIN filters f ON ((s.applied | s.bit) & f.bit) = 0
)
SELECT prefix, step, mask, kept, removed, redundant, alone FROM steps WHERE step > 0
"""


def steps(spark: SparkSession, letters: str = LETTERS) -> DataFrame:
    """(prefix, step, mask, kept, removed, redundant, alone): what the last filter of each prefix does to documents of each mask."""
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"between one and {MOST_FILTERS} different letters")
    return spark.sql(STEPS.format(letters=letters, count=len(letters), masks=1 << len(letters)))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of all filters and step."""
    enumerated = materialise(steps(cells.sparkSession, letters))
    counted = lambda where, what="n": F.sum(F.when(F.col(where), F.col(what)).otherwise(0))
    prefixes = cells.join(F.broadcast(enumerated), "mask").groupBy("part", "prefix", "step").agg(
        counted("kept").alias("kept"), counted("removed").alias("removed"), counted("redundant").alias("redundant"), counted("alone").alias("unique_fails"),
        counted("removed", "n_good").alias("good_lost"), counted("removed", "n_toxic").alias("toxic_lost"),
    )
    # a prefix of k filters begins (count - k)! orders
    orders_of = F.element_at(F.array(*[F.lit(factorial(len(letters) - k)) for k in range(1, len(letters) + 1)]), F.col("step"))
    letter = F.substring("prefix", -1, 1)
    total = F.sum(F.col("removed") * orders_of).over(Window.partitionBy("part", letter))
    orders = enumerated.filter((F.col("step") == len(letters)) & (F.col("mask") == 0)).select(F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    placed = orders.select("filter_order", "step", F.expr("substr(filter_order, 1, step)").alias("prefix"))
    out = prefixes.withColumn("shapley", total).drop("step").join(F.broadcast(placed), "prefix")
    whole = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *[F.col(c).cast("bigint").alias(c) for c in whole])


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH RECURSIVE marks AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), m AS (
  SELECT doc_id, part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM w
), cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(toxic, 0)) AS n_toxic FROM m LEFT JOIN marks USING (doc_id) GROUP BY part, mask
), filters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
walk(prefix, step, applied, letter, bit) AS (
  SELECT '', 0, 0, '', 0
  UNION ALL
  SELECT prefix || f.letter, step + 1, applied | walk.bit, f.letter, f.bit FROM walk JOIN filters f ON ((applied | walk.bit) & f.bit) = 0
), s AS (
  SELECT part, prefix, step, letter,
         sum(CASE WHEN (mask & (applied | bit)) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN (mask & bit) <> 0 AND (mask & applied) = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN (mask & bit) <> 0 AND (mask & applied) <> 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN (mask & bit) <> 0 AND (mask & applied) = 0 THEN n_good ELSE 0 END) AS good_lost,
         sum(CASE WHEN (mask & bit) <> 0 AND (mask & applied) = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM walk CROSS JOIN cells WHERE step > 0 GROUP BY part, prefix, step, letter
), o AS (
  SELECT s.*, f.prefix AS filter_order FROM s JOIN walk f ON f.step = 5 AND substr(f.prefix, 1, s.step) = s.prefix
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM o
"""
