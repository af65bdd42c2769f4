"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's rows are cut into blocks.  A source with weight w (the weights of the
sources still present add up to 1) gets its j-th block (from 0) released at slot
floor(j / w) with deadline ceil((j + 1) / w).  In every slot the released block with the
earliest deadline runs.  Unit jobs, integer windows and a full processor make this
schedule meet all deadlines, so at any slot a source is less than one block away from
its target.

Weights are whole shares in exactly the ratio asked for: 0.00012, 0.12345 and 0.87643 are 12,
12345 and 87643.  After as many slots as the shares add up to, every source has run its
share to the block and the schedule repeats; so one cycle is folded, on one row, and a
block finds its slot by (block number modulo share).  Weights whose cycle would pass LONGEST
are refused, not rounded.  Without given weights the targets are whole shares of about
GRID slots, at least 1, in the ratio of the sources' sizes to a power.

When a source ends, a phase ends: the schedule begins anew among the others, in
proportion; so every row gets a place and nothing is dropped or repeated.  There are
at most as many phases as sources, which may be some hundreds; their cycles reach the
tasks as one value of bounded size.

Rows are numbered within their source without gathering a source in one task: hash
parts of bounded size are counted, the counts are summed up, and rows are numbered
within their part.

Rules: a null source is a source of its own (named null); a source without a target
weight takes part with weight 0 and follows after the others, by name; repeated rows
each get a place; rows of equal key are ordered by a hash of the whole row, so only equal
rows are in no order; columns may have any names, and mix_block, mix_slot and
mix_position replace columns of these names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import named, row_hash, table

#: Slots of the longest cycle of given weights, and of a cycle of weights by size (about).
LONGEST, GRID = 200_000, 20_000
FOLD = 256  # slots folded into one array at once
BLOCK_ROWS = 16
#: Rows of a source numbered together, about; small sources and tables get up to PARTS
#: parts of at least LEAST_ROWS, so that a large source is dealt evenly over tasks.
PART_ROWS, LEAST_ROWS, PARTS = 50_000, 50, 256


def let(value: Column, body) -> Column:
    """Evaluate a column once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def exact_shares(weights: Mapping[str, float | Fraction]) -> dict[str, int]:
    """Whole numbers in the ratio of the weights; a weight is the fraction that its float stands for."""
    exact = {name: Fraction(w).limit_denominator(LONGEST) for name, w in weights.items()}
    wrong = [name for name, w in weights.items() if abs(float(exact[name]) - float(w)) > 1e-12 * abs(float(w)) or w < 0]
    common = lcm(*(w.denominator for w in exact.values()))
    shares = {name: int(w * common) for name, w in exact.items()}
    least = gcd(*shares.values()) or 1
    shares = {name: n // least for name, n in shares.items()}
    if wrong or sum(shares.values()) > LONGEST:
        raise ValueError(f"weights must be 0 or more and repeat within {LONGEST} slots; give fewer digits or fractions ({wrong or 'their sum'})")
    return shares


def edf_cycle(shares: Column, length: Column) -> Column:
    """array<bigint> of shares -> array<int>: the source position run in each of the first `length` slots.

    The fold keeps each source's number of blocks run so far; slots are put together in
    pieces, so that no long array is copied for every slot."""
    none = F.array().cast("array<int>")

    def slots(s: Column) -> Column:
        def step(state: Column, slot: Column) -> Column:
            # (deadline, position) of each source whose next block is released; the least wins
            ready = F.transform(
                F.arrays_zip(state["run"].alias("run"), shares.alias("share")),
                lambda z, i: F.when((z["share"] > 0) & (z["run"] * s < (slot + 1) * z["share"]), F.struct(F.ceil((z["run"] + 1) * s / z["share"]).alias("deadline"), i.alias("at"))),
            )
            won = F.array_min(F.filter(ready, lambda x: x.isNotNull()))["at"]
            return let(won, lambda w: F.struct(F.transform(state["run"], lambda n, i: n + F.when(i == w, 1).otherwise(0)).alias("run"), F.concat(state["out"], F.array(w)).alias("out")))

        def piece(state: Column, first: Column) -> Column:
            slots_of = F.sequence(first, F.least(first + FOLD, length) - 1)
            made = F.aggregate(slots_of, F.struct(state["run"].alias("run"), none.alias("out")), step)
            return let(made, lambda x: F.struct(x["run"].alias("run"), F.concat(state["out"], x["out"]).alias("out")))

        start = F.struct(F.transform(shares, lambda x: F.lit(0).cast("bigint")).alias("run"), none.alias("out"))
        return F.when(length > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), length - 1, F.lit(FOLD).cast("bigint")), start, piece, lambda state: state["out"])).otherwise(none)

    return let(total(shares), slots)


def shares_of(weights: Column, grid: int = GRID) -> Column:
    """Weights -> whole shares, at least 1 for a positive weight; close to `grid` in sum."""
    whole = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.transform(weights, lambda w: F.when(w > 0, F.greatest(F.lit(1), F.round(w / whole * grid).cast("bigint"))).otherwise(F.lit(0).cast("bigint")))


def reduced(shares: Column) -> Column:
    """Shares divided by their greatest common divisor, by Euclid's steps; 0 stays 0."""
    step = lambda x, _: F.when(x["b"] > 0, F.struct(x["b"].alias("a"), (x["a"] % x["b"]).alias("b"))).otherwise(x)
    divisor = F.aggregate(shares, F.lit(0).cast("bigint"), lambda g, q: F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(F.greatest(g, q).alias("a"), F.least(g, q).alias("b")), step, lambda x: x["a"]))
    return let(F.greatest(divisor, F.lit(1)), lambda d: F.transform(shares, lambda q: (q / d).cast("bigint")))


def source_name(source: str) -> Column:
    """A source as text that tells null from every name."""
    return F.coalesce(F.concat(F.lit("="), named(source).cast("string")), F.lit(""))


def numbered(df: DataFrame, source: str, key: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """row (all columns), source (see `source_name`) and n, the row's number from 0 within its source, in the order of a hash of `key`."""
    largest = df.groupBy(named(source)).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-largest // part_rows), min(PARTS, largest // LEAST_ROWS))
    whole = F.struct(*[named(c) for c in df.columns])
    marked = df.select(whole.alias("row"), source_name(source).alias("source"), F.xxhash64(*[named(k) for k in key]).alias("h"), F.struct(*[named(k) for k in key]).alias("key"), row_hash(df).alias("tie"))
    marked = marked.withColumn("part", (F.shiftrightunsigned("h", 33) * F.lit(parts) / F.lit(2**31)).cast("int"))
    sizes = marked.groupBy("source", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("source", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "part").orderBy("h", "key", "tie")
    placed = marked.withColumn("r", F.row_number().over(inner) - 1).join(starts, ["source", "part"])
    return placed.select("row", "source", (F.col("start") + F.col("r")).alias("n"))


def phases(blocks: DataFrame, weights: Mapping[str, float | Fraction] | None, power: float, grid: int) -> DataFrame:
    """(source, blocks) -> one row a phase: its sources, their shares, one cycle, first slot and blocks run before."""
    if weights is None:
        weight = F.pow(F.col("blocks").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, value in exact_shares(weights).items():
            weight = F.when(F.col("source") == f"={name}", F.lit(float(value))).otherwise(weight)
    rows = blocks.withColumn("weight", weight).withColumn("late", F.col("weight") <= 0)
    # sources without a weight form later groups of their own, by name
    groups = rows.withColumn("grp", F.when(F.col("late"), F.concat(F.lit("1"), F.col("source"))).otherwise(F.lit("0"))).withColumn("weight", F.when(F.col("late"), 1.0).otherwise(F.col("weight")))
    packed = groups.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("source", "blocks", "weight"))).alias("s"))
    given = F.transform("s", lambda x: x["weight"])
    share = shares_of(given, grid) if weights is None else F.transform(given, lambda w: w.cast("bigint"))
    packed = packed.select("grp", F.transform("s", lambda x: x["source"]).alias("names"), F.transform("s", lambda x: x["blocks"]).alias("left"), share.alias("share"))

    zero = F.lit(0).cast("bigint")
    phase_type = "array<struct<order:array<int>,shares:array<bigint>,counts:array<bigint>,first:array<bigint>,slot:bigint>>"

    def step(state: Column, _: Column) -> Column:
        """Full cycles while every source present has its share left, then the beginning of one up to the first that ends."""
        now = reduced(F.zip_with(state["left"], F.col("share"), lambda n, q: F.when(n > 0, q).otherwise(zero)))

        def begin(q: Column) -> Column:
            full = F.array_min(F.zip_with(state["left"], q, lambda n, x: F.when(n > 0, F.floor(n / x))))
            return let(F.struct(q.alias("now"), full.alias("k"), edf_cycle(q, F.least(total(q), total(state["left"]))).alias("order")), go)

        def go(x: Column) -> Column:
            ran = F.transform(x["now"], lambda q: q * x["k"])
            rest = F.zip_with(state["left"], ran, lambda n, q: n - q)
            return let(F.struct(x["now"].alias("now"), x["order"].alias("order"), ran.alias("ran"), rest.alias("rest")), cut)

        def cut(x: Column) -> Column:
            ends = F.transform(x["rest"], lambda n, i: F.when((F.get(x["now"], i) > n) & (n > 0), F.get(F.filter(F.sequence(F.lit(1), F.size(x["order"])), lambda at: F.get(x["order"], at - 1) == i), (n - 1).cast("int"))).when((F.get(x["now"], i) > 0) & (n == 0), F.lit(0)))
            return let(F.slice(x["order"], F.lit(1), F.coalesce(F.array_min(ends), F.size(x["order"]))), lambda part: close(x, part))

        def close(x: Column, part: Column) -> Column:
            counts = F.transform(x["rest"], lambda _, i: F.size(F.filter(part, lambda w: w == i)).cast("bigint"))
            first = F.zip_with(state["run"], x["ran"], lambda n, q: n + q)
            slot = state["slot"] + total(x["ran"])
            return let(
                counts,
                lambda c: F.struct(
                    F.zip_with(x["rest"], c, lambda n, q: n - q).alias("left"),
                    F.zip_with(first, c, lambda n, q: n + q).alias("run"),
                    (slot + total(c)).alias("slot"),
                    F.concat(
                        state["out"],
                        F.array(
                            F.struct(x["order"].alias("order"), x["now"].alias("shares"), x["ran"].alias("counts"), state["run"].alias("first"), state["slot"].alias("slot")),
                            F.struct(part.alias("order"), x["now"].alias("shares"), c.alias("counts"), first.alias("first"), slot.alias("slot")),
                        ),
                    ).alias("out"),
                ),
            )

        return F.when(F.exists(state["left"], lambda n: n > 0), let(now, begin)).otherwise(state)

    start = F.struct(F.col("left"), F.transform("left", lambda x: zero).alias("run"), zero.alias("slot"), F.array().cast(phase_type).alias("out"))
    folded = packed.select("grp", "names", F.aggregate(F.sequence(F.lit(1), F.size("left")), start, step, lambda s: s["out"]).alias("out"), total(F.col("left")).alias("all"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # a row a group, as many as sources without weight
    based = folded.withColumn("base", F.coalesce(F.sum("all").over(before), zero))
    each = based.select("names", "base", F.explode("out").alias("p")).filter(total(F.col("p.counts")) > 0)
    return each.select("names", "p.order", "p.shares", "p.counts", "p.first", (F.col("p.slot") + F.col("base")).alias("slot"))


def schedule(plan: DataFrame) -> DataFrame:
    """Phases -> (source, first, last, share, at, slot, step): block b of first .. last runs at
    slot + at[k] + step * ((b - first) div share), where k = (b - first) mod share."""
    each = plan.select("order", "shares", "counts", F.col("first").alias("firsts"), "slot", F.size("order").cast("bigint").alias("step"), F.posexplode("names").alias("who", "source"))
    mine = lambda c: F.get(c, F.col("who"))
    at = F.filter(F.sequence(F.lit(0), F.size("order") - 1), lambda x: F.get(F.col("order"), x) == F.col("who"))
    each = each.select("source", mine("firsts").alias("first"), mine("counts").alias("n"), mine("shares").alias("share"), at.alias("at"), "slot", "step").filter("n > 0")
    return each.select("source", "first", (F.col("first") + F.col("n") - 1).alias("last"), "share", "at", "slot", "step")


def mix(df: DataFrame, source: str = "source", key: Sequence[str] = ("doc_id",), weights: Mapping[str, float | Fraction] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, grid: int = GRID, part_rows: int = PART_ROWS) -> DataFrame:
    """All rows plus `mix_block` (number within the source), `mix_slot` and `mix_position`.

    Weights: a mapping by source, or by default each source's size to `power` (0.5
    brings large and small sources nearer to each other)."""
    rows = numbered(df, source, key, part_rows).withColumn("block", F.floor(F.col("n") / block_rows))
    counted = df.select(source_name(source).alias("source")).groupBy("source").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    runs = schedule(phases(counted, weights, power, grid)).groupBy("source").agg(F.collect_list(F.struct("first", "last", "share", "at", "slot", "step")).alias("runs"))
    # one value for all tasks: a list of runs a source, of as many numbers as its cycles have slots
    plan = runs.agg(F.map_from_entries(F.collect_list(F.struct("source", "runs"))).alias("plan"))
    mine = F.filter("runs", lambda r: (F.col("block") >= r["first"]) & (F.col("block") <= r["last"]))
    slot_of = lambda r: let(F.col("block") - r["first"], lambda b: r["slot"] + F.get(r["at"], (b % r["share"]).cast("int")) + r["step"] * F.floor(b / r["share"]))
    placed = rows.withColumn("runs", F.element_at(plan.scalar(), F.col("source"))).withColumn("slot", F.get(F.transform(mine, slot_of), F.lit(0)))
    new = {"mix_block": F.col("block"), "mix_slot": F.col("slot"), "mix_position": F.col("slot") * block_rows + F.col("n") % block_rows}
    return placed.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in new], *[v.alias(k) for k, v in new.items()])


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
