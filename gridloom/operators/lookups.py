"""Lookups and joins by key, position and range.

Keys are compared alike everywhere: texts without regard to case, other types as they are.
Order comes from an explicit column.  Nearest matches are unions with a window over the
lookup key, not range joins, so they sort and stream; rows are cut into ranges first and
only the last value before each range is carried over.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import pinned


def folded(df: DataFrame, column: str) -> Column:
    """A key as lookups compare it."""
    return F.lower(F.col(column)) if dict(df.dtypes)[column] == "string" else F.col(column)


def first_rows(table: DataFrame, key: str, order_by: str, value: str, into: str, last: bool = False) -> DataFrame:
    """(_key, into): the value of the first (or last) row of each folded key, reading these columns only.

    Of rows of equal `order_by` the smallest value counts (or, if `last`, the largest).  Aggregated before
    the shuffle, so a hot key is no hot task."""
    chosen = (F.max_by if last else F.min_by)(F.struct(F.col(value).alias("v")), F.struct(order_by, value))
    return table.groupBy(folded(table, key).alias("_key")).agg(chosen["v"].alias(into))


def with_found(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Left join with (_key, ...), one row a folded key at most: no row of `df` is multiplied."""
    return df.join(found, folded(df, key) == F.col("_key"), "left").drop("_key")


def vlookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order_by: str, into: str | None = None, exact: bool = True) -> DataFrame:
    """Value of the first matching row, or, sorted and approximate, of the last row with a key not above."""
    into = into or value
    if not exact:
        return nearest(df, key, table, table_key, value, into, "below")
    return with_found(df, key, first_rows(table, table_key, order_by, value, into))


def in_ranges(df: DataFrame, order_by: Sequence[str | Column], part: str = "_part") -> DataFrame:
    """Rows in range partitions of the given order, with the number of the partition; pinned, so
    that the partitions are the same wherever the frame is used."""
    return pinned(df.repartitionByRange(*order_by).withColumn(part, F.spark_partition_id()))


def carried(ranges: DataFrame, by: Sequence[str], value: Column, into: str, added: bool = False) -> DataFrame:
    """(_part, *by, into): for keys that span partitions, an aggregate carried over from those before.

    Ranges are contiguous, so at most one key spans each border: the frame has at most two
    rows a partition and may be broadcast.  `value` is an aggregate; of those before the last is
    taken, or, if `added`, their sum."""
    per = ranges.groupBy("_part", *by).agg(value.alias("_value"))
    mine = Window.partitionBy(*by).orderBy("_part")
    earlier = mine.rowsBetween(Window.unboundedPreceding, -1)
    before = F.sum("_value").over(earlier) if added else F.last("_value", ignorenulls=True).over(earlier)
    spans = F.count("*").over(Window.partitionBy(*by)) > 1
    return per.withColumn(into, before).withColumn("_spans", spans).filter("_spans").select("_part", *by, into)


def with_carried(ranges: DataFrame, over: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ranges with what `carried` gives; missing keys are equal to each other."""
    apart = over.select(F.col("_part").alias("_p0"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(by)], *[c for c in over.columns if c not in ("_part", *by)])
    same = F.col("_part") == F.col("_p0")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    return ranges.join(F.broadcast(apart), same, "left").drop("_p0", *[f"_c{i}" for i in range(len(by))])


def nearest(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, into: str, side: str = "below", by: Sequence[str] = ()) -> DataFrame:
    """Value of the table row whose key is the largest not above (`below`) or the smallest not below
    (`above`), within the columns `by` if given; equal table keys give the smallest value.  Missing values of
    `by` are a group like any other, a missing key finds nothing.

    Keys are ordered in their own type: whole numbers of any size, times and texts (folded) alike.
    Both sides are laid out in ranges of (by, key), so neither a hot key nor the lack of one puts
    all rows into one task; each range takes over the last table row of the ranges before it."""
    kinds = dict(df.dtypes)
    below = side == "below"
    order = F.asc("_o") if below else F.desc("_o")
    left = df.withColumn("_o", folded(df, key)).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(table.dtypes)[value]))
    right = table.filter(F.col(table_key).isNotNull()).select(*by, folded(table, table_key).alias("_o"), F.col(value).alias("_v")).groupBy(*by, "_o").agg(F.min("_v").alias("_v")).withColumn("_side", F.lit(0))
    for c in df.columns:
        if c not in by:
            right = right.withColumn(c, F.lit(None).cast(kinds[c]))
    names = [*df.columns, "_o", "_side", "_v"]
    both = left.select(*names).unionByName(right.select(*names)).withColumn("_has", F.when(F.col("_side") == 0, F.struct("_v")))
    ranges = in_ranges(both, [*by, order])
    over = carried(ranges, by, (F.max_by if below else F.min_by)("_has", F.when(F.col("_side") == 0, F.col("_o"))), "_before")
    w = Window.partitionBy("_part", *by).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = with_carried(ranges, over, by).withColumn("_f", F.coalesce(F.last("_has", ignorenulls=True).over(w), F.col("_before")))
    return out.filter("_side = 1").select(*df.columns, F.when(F.col("_o").isNotNull(), F.col("_f._v")).alias(into))


def hlookup(df: DataFrame, key: str, table: DataFrame, row_column: str, row: object, into: str) -> DataFrame:
    """Table whose column names are the searched row; value from the row where `row_column` equals `row`.

    Of column names that differ in case only, the first counts."""
    names: dict[str, str] = {}
    for c in table.columns:
        if c != row_column:
            names.setdefault(c.lower(), c)
    long = table.filter(F.col(row_column) == row).unpivot([], list(names.values()), "_name", "_value").groupBy(F.lower("_name").alias("_key")).agg(F.first("_value").alias(into))
    return with_found(df, key, long)


def positions(table: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Adds `position`, 1-based in the given order, numbered by ranges rather than in one task."""
    ordered = in_ranges(table, order_by)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")  # a row a partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return ordered.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + inner).drop("_part", "_before")


def match_position(df: DataFrame, key: str, vector: DataFrame, value: str, position: str, kind: int = 1, into: str = "matched") -> DataFrame:
    """0: first equal value; 1: last position of a value not above the key; -1: last of one not below."""
    if kind == 0:
        return with_found(df, key, vector.groupBy(folded(vector, value).alias("_key")).agg(F.min(position).alias(into)))
    # the answer per distinct value is a running maximum of positions in value order
    top = vector.filter(F.col(value).isNotNull()).groupBy(folded(vector, value).alias("_k")).agg(F.max(position).alias("_p"))
    order = F.asc("_k") if kind == 1 else F.desc("_k")
    ranges = in_ranges(top, [order])
    ends = ranges.groupBy("_part").agg(F.max("_p").alias("_end"))
    before = ends.select("_part", F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))  # a row a partition
    w = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = ranges.join(F.broadcast(before), "_part").withColumn("_p", F.greatest(F.max("_p").over(w), "_before"))
    return nearest(df, key, running, "_k", "_p", into, "below" if kind == 1 else "above")


#: Lengths of the pieces by which patterns and texts meet; a run of a pattern is cut into the longest that fits.
GRAM, SIZES = 3, (3, 6, 12, 24, 48)
#: Up to this many distinct patterns are sent to every task.
FEW = 100_000


def met(left: DataFrame, right: DataFrame, on: str, few: bool, how: str = "inner") -> DataFrame:
    """A join that never broadcasts `left`, whose rows were multiplied behind the planner's back, and `right` only if it is few rows."""
    return left.join(F.broadcast(right), on, how) if few else left.hint("merge").join(right, on, how)


def wildcard_pairs(df: DataFrame, key: str, values: DataFrame, text: str) -> DataFrame:
    """(_key, columns of `values`): each distinct pattern of `df` (`*` any text, `?` one character, no case) with the texts it fits.

    A pattern with a literal run of GRAM characters meets only the texts that hold its rarest piece and end as it
    does, by an equi-join on both; the regular expression is tried on those.  Patterns of shorter runs are
    compared with every text: the one case in which nothing tells them apart."""
    special = F.regexp_replace(F.col("_key"), r"([\\\[\]{}().+^$|])", r"\\$1")
    pattern = F.concat(F.lit("(?is)^"), F.regexp_replace(F.regexp_replace(special, r"\*", ".*"), r"\?", "."), F.lit(r"\z"))
    cut = lambda x, size: F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: F.substr(x, i, size))
    # a piece is named by its length, that of the ending, and the ending before itself
    ending = lambda size, n, x: F.concat_ws("/", size.cast("string"), n.cast("string"), F.right(x, n))
    runs = F.split(F.lower(F.col("_key")), r"[*?]+")
    last = F.element_at(runs, -1)
    end = F.least(F.length(last), F.lit(GRAM))
    size = lambda x: F.coalesce(*[F.when(F.length(x) >= n, F.lit(n)) for n in reversed(SIZES)])
    asks = F.array_distinct(F.flatten(F.transform(F.filter(runs, lambda x: F.length(x) >= GRAM), lambda x: F.transform(cut(x, size(x)), lambda y: F.struct(size(x).alias("size"), end.alias("end"), F.concat(ending(size(x), end, last), y).alias("gram"))))))
    keys = pinned(df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key")).distinct().select("_key", pattern.alias("_pattern"), asks.alias("_asks")))
    few = keys.count() <= FEW
    # copies of a text are met once
    texts = pinned(values.filter(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct())

    def spread(shapes: DataFrame) -> DataFrame:
        """Texts by their pieces of the lengths that patterns ask for."""
        low, s = F.lower("_text"), F.col("_shape")
        held = texts.withColumn("_shape", F.explode(shapes.agg(F.collect_set(F.struct("_ask.size", "_ask.end"))).scalar())).filter((F.length(low) >= s["size"]) & (F.length(low) >= s["end"]))
        begun = held.select("_text", low.alias("_low"), s["size"].alias("_size"), ending(s["size"], s["end"], low).alias("_ending"))
        return begun.select("_text", "_ending", F.explode(F.array_distinct(cut(F.col("_low"), F.col("_size")))).alias("_piece")).select("_text", F.concat("_ending", "_piece").alias("_gram"))

    wanted = keys.select("_key", F.explode("_asks").alias("_ask")).withColumn("_gram", F.col("_ask.gram"))
    frequency = met(spread(wanted), wanted.select("_gram").distinct(), "_gram", few, "left_semi").groupBy("_gram").agg(F.count("*").alias("_n"))
    # a piece that no text holds tells that the pattern fits none
    rarest = pinned(met(wanted, frequency, "_gram", few, "left").groupBy("_key").agg(F.min_by("_ask", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_ask")))
    chosen = met(rarest, keys.select("_key", "_pattern"), "_key", few).withColumn("_gram", F.col("_ask.gram")).select("_gram", "_key", "_pattern")
    found = met(spread(rarest), chosen, "_gram", few).drop("_gram")
    bare = keys.filter(F.size("_asks") == 0).select("_key", "_pattern")
    fits = F.regexp_like(F.col("_text"), F.col("_pattern"))
    if n := bare.count():
        pairs = texts.join(F.broadcast(bare), fits) if n <= FEW else texts.hint("shuffle_replicate_nl").join(bare, fits)
        found = found.unionByName(pairs.select(*found.columns))
    return met(found.filter(fits).select("_key", "_text"), values.withColumn("_text", F.col(text)), "_text", False).drop("_text")


def xlookup(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order_by: str, into: str, mode: int = 0, if_missing: object = None, last: bool = False) -> DataFrame:
    """Modes: 0 exact, -1 exact or next smaller, 1 exact or next larger, 2 wildcard (the key is a pattern)."""
    if mode == 0:
        out = with_found(df, key, first_rows(table, table_key, order_by, value, into, last))
    elif mode in (-1, 1):
        out = nearest(df, key, table, table_key, value, into, "below" if mode == -1 else "above")
    else:
        hits = wildcard_pairs(df, key, table.groupBy(table_key).agg((F.max if last else F.min)(F.struct(F.col(order_by).alias("o"), F.col(value).alias("v"))).alias("_row")), table_key)
        hits = hits.groupBy("_key").agg((F.max if last else F.min)("_row").alias("_row"))
        out = df.join(hits.select("_key", F.col("_row.v").alias(into)), F.col(key) == F.col("_key"), "left").drop("_key")
    return out if if_missing is None else out.withColumn(into, F.coalesce(F.col(into), F.lit(if_missing)))


def xmatch(df: DataFrame, key: str, table: DataFrame, table_key: str, position: str, into: str = "matched", mode: int = 0, last: bool = False) -> DataFrame:
    return xlookup(df, key, table, table_key, position, position, into, mode, None, last)


def lookup_vector(df: DataFrame, key: str, vector: DataFrame, value: str, result: str, into: str) -> DataFrame:
    """Result beside the last value not above the key."""
    return nearest(df, key, vector, value, result, into, "below")


def index_match(df: DataFrame, key: str, table: DataFrame, table_key: str, column: str, position: str, into: str) -> DataFrame:
    """Two steps: position of the first match, then any column at that position."""
    at = match_position(df, key, table, table_key, position, 0, "_at")
    return at.join(table.select(F.col(position).alias("_pos"), F.col(column).alias(into)), F.col("_at") == F.col("_pos"), "left").drop("_at", "_pos")


def diff_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ or that exist on one side: change is added, removed or changed.

    Missing keys are equal to each other."""
    a = before.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_old"), F.lit(True).alias("_a"))
    b = after.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.struct(*values).alias("_new"), F.lit(True).alias("_b"))
    same = reduce(and_, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))])
    both = a.join(b, same, "full_outer").filter(~(F.col("_old").eqNullSafe(F.col("_new"))) | F.col("_a").isNull() | F.col("_b").isNull())
    both = both.select("*", *[F.when(F.col("_a").isNull(), F.col(f"_b{i}")).otherwise(F.col(f"_a{i}")).alias(k) for i, k in enumerate(keys)])
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.select(*keys, change.alias("change"), F.col("_old").alias("old"), F.col("_new").alias("new"))


def removed_items(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(new.select(*keys), list(keys), "left_anti")


def listed(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Rows whose key occurs in the table."""
    return df.join(table.select(F.col(table_key).alias(key)), key, "left_semi")


def resolve_refs(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """edges(project_id, sheet, row, col) -> value of the referenced cell; a missing sheet is told apart."""
    low = lambda c: F.lower(F.col(c))
    values = cells.select("project_id", low("sheet_id").alias("_sheet"), "row", "col", "v_num", "v_str", "v_bool", "t")
    sheets = values.select("project_id", "_sheet", F.lit(True).alias("_there")).distinct()
    keyed = edges.withColumn("_sheet", low("sheet"))
    out = keyed.join(sheets, ["project_id", "_sheet"], "left").join(values, ["project_id", "_sheet", "row", "col"], "left")
    return out.withColumn("missing_sheet", F.col("_there").isNull()).drop("_sheet", "_there")


def merge_cover(merges: DataFrame) -> DataFrame:
    """merges(sheet_id, r0, c0, r1, c1) -> every covered cell with its anchor."""
    rows = merges.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return rows.select("sheet_id", "row", "col", F.col("r0").alias("anchor_row"), F.col("c0").alias("anchor_col"), ((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))).alias("hidden"))


def resolve_names(names: DataFrame, cells: DataFrame, blanks: bool = True) -> DataFrame:
    """names(sheet_id, name, r0, c0, r1, c1) -> one row a named cell with its value.

    Without `blanks` the cells that exist only, met by tiles: for names of whole columns or sheets."""
    if not blanks:
        met = in_areas(names.select("sheet_id", "name", "r0", "c0", "r1", "c1"), cells.select("sheet_id", "row", "col", "v_num", "v_str", "t"), ["sheet_id"])
        return met.select("sheet_id", "name", "row", "col", "v_num", "v_str", "t")
    area = names.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return area.select("sheet_id", "name", "row", "col").join(cells.select("sheet_id", "row", "col", "v_num", "v_str", "t"), ["sheet_id", "row", "col"], "left")


def merged_cells(merges: DataFrame, cells: DataFrame) -> DataFrame:
    """Existing cells under merges(sheet_id, r0, c0, r1, c1), with the anchor: `merge_cover` without the blank ones, met by tiles."""
    turned = merges.select("sheet_id", F.least("r0", "r1").alias("r0"), F.least("c0", "c1").alias("c0"), F.greatest("r0", "r1").alias("r1"), F.greatest("c0", "c1").alias("c1"))
    met = in_areas(turned, cells.select("sheet_id", "row", "col"), ["sheet_id"])
    return met.select("sheet_id", "row", "col", F.col("r0").alias("anchor_row"), F.col("c0").alias("anchor_col"), ((F.col("row") != F.col("r0")) | (F.col("col") != F.col("c0"))).alias("hidden"))


#: Powers of two of the sides of tiles: rows and columns.
ROW_BITS, COL_BITS = (4, 8, 12, 16, 20), (2, 5, 8, 11, 14)


def in_areas(areas: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """areas(*keys, r0, c0, r1, c1, ...) with the cells(*keys, row, col, ...) that lie in them: a range join by tiles.

    An area takes the smallest tiles that are no smaller than it, so it touches four at most, however large it
    is; a cell has one tile of each size that some area takes (25 sizes at most).  They meet by an
    equi-join on keys and tile, and the bounds are tested inside.  Ends may come in either order."""
    bits = lambda size, steps: F.coalesce(*[F.when(size <= (1 << b), F.lit(b)) for b in steps], F.lit(steps[-1]))
    ends = {"_r0": F.least("r0", "r1"), "_r1": F.greatest("r0", "r1"), "_c0": F.least("c0", "c1"), "_c1": F.greatest("c0", "c1")}
    sized = areas.withColumns(ends).withColumns({"_rb": bits(F.col("_r1") - F.col("_r0") + 1, ROW_BITS), "_cb": bits(F.col("_c1") - F.col("_c0") + 1, COL_BITS)})
    tile = lambda x, b: F.expr(f"shiftright(CAST({x} AS BIGINT), {b})")
    span = lambda a, b, n: F.explode(F.sequence(tile(a, n), tile(b, n)))
    tiled = sized.withColumn("_rt", span("_r0", "_r1", "_rb")).withColumn("_ct", span("_c0", "_c1", "_cb"))
    sizes = sized.select("_rb", "_cb").distinct().agg(F.collect_set(F.struct("_rb", "_cb")).alias("_sizes"))
    placed = cells.withColumn("_size", F.explode(sizes.scalar())).withColumns({"_rb": F.col("_size._rb"), "_cb": F.col("_size._cb")}).withColumns({"_rt": tile("row", "_rb"), "_ct": tile("col", "_cb")}).drop("_size")
    met = tiled.join(placed, [*keys, "_rb", "_cb", "_rt", "_ct"])
    return met.filter(F.col("row").between(F.col("_r0"), F.col("_r1")) & F.col("col").between(F.col("_c0"), F.col("_c1"))).drop(*ends, "_rb", "_cb", "_rt", "_ct")
