"""Criteria, filters, rule flags and search over columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import join_alike
from ..functions.typed import infer

COMPARE = {
    "<>": lambda a, b: a != b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "=": lambda a, b: a == b,
}


def wildcard(spec: str) -> str:
    """`*` and `?` as an anchored pattern without case; `~` takes the next sign literally."""
    out = "".join(".*" if t == "*" else "." if t == "?" else re.escape(t[-1]) for t in re.findall(r"~[*?~]|.", spec, re.S))
    return f"(?is)^{out}$"


def criteria(column: Column, spec: float | str, numeric: bool | None = None) -> Column:
    """Predicate of a criterion: a number equals; `< > <= >= <> =` compare; `*` and `?`
    match without case; other text equals without case; an empty operand means blank.
    Never NULL.  `numeric` says whether the column holds numbers (guessed from the operand)."""
    # NULL-free by null tests rather than coalesce, so that filters still reach the scan
    if not isinstance(spec, str):
        return column.isNotNull() & (column == F.lit(spec))
    sign = next((s for s in COMPARE if spec.startswith(s)), "")
    rest = spec[len(sign) :]
    try:
        number = float(rest)
    except ValueError:
        number = None
    blank = column.isNull() | (column.cast("string") == "")
    if rest == "":
        return ~blank if sign == "<>" else blank
    if number is not None and numeric is not False:
        value = column.cast("double")
        found = COMPARE[sign or "="](value, F.lit(number))
        return value.isNull() | found if sign == "<>" else value.isNotNull() & found
    text = F.lower(column.cast("string"))
    if sign in ("", "=", "<>") and re.search(r"[*?]", rest):
        found = column.cast("string").rlike(wildcard(rest))
        found = ~found if sign == "<>" else found
    else:
        found = COMPARE[sign or "="](text, F.lit(rest.lower()))
    return column.isNull() | found if sign == "<>" else column.isNotNull() & found


def filter_rows(df: DataFrame, mask: Column, if_empty: Sequence | None = None) -> DataFrame:
    """Rows whose mask is true; if there are none, the fallback row when one is given."""
    kept = df.filter(mask)  # NULL is not kept
    if if_empty is None:
        return kept
    fallback = df.sparkSession.createDataFrame([tuple(if_empty)], df.schema)
    return kept.unionByName(fallback.join(kept.limit(1).select(F.lit(1).alias("_any")), how="left_anti", on=F.lit(True)))


def rule_test(column: Column, rule: dict) -> Column:
    """One rule: {kind, value, value2}.  Kinds: eq ne gt ge lt le between notbetween, contains,
    notcontains, begins, ends, blank, notblank, expression (value is a Column)."""
    kind, value = rule["kind"], rule.get("value")
    text = F.lower(F.coalesce(column.cast("string"), F.lit("")))
    word = str(value).lower() if not isinstance(value, Column) else value
    tests = {
        "eq": lambda: column == value,
        "ne": lambda: column != value,
        "gt": lambda: column > value,
        "ge": lambda: column >= value,
        "lt": lambda: column < value,
        "le": lambda: column <= value,
        "between": lambda: column.between(value, rule["value2"]),
        "notbetween": lambda: ~column.between(value, rule["value2"]),
        "contains": lambda: text.contains(word),
        "notcontains": lambda: ~text.contains(word),
        "begins": lambda: text.startswith(word),
        "ends": lambda: text.endswith(word),
        "blank": lambda: F.trim(text) == "",
        "notblank": lambda: F.trim(text) != "",
        "expression": lambda: value,
    }
    return F.coalesce(tests[kind](), F.lit(False))


def flag_rules(df: DataFrame, rules: Sequence[dict], into: str = "flag") -> DataFrame:
    """Name of the rule of lowest priority number that holds; rules are {name, priority, column, kind, ...}."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: r["priority"], reverse=True):
        out = F.when(rule_test(F.col(rule["column"]), rule), F.lit(rule["name"])).otherwise(out)
    return df.withColumn(into, out)


def flag_ranked(df: DataFrame, column: str, kind: str, n: int = 10, by: Sequence[str] = (), into: str = "flag") -> DataFrame:
    """Range rules: top, bottom (n with ties), above, below (average), duplicate, unique.

    Without `by` the bounds come from an aggregate that is joined back, not from one window over all rows."""
    x = F.col(column)
    if kind in ("duplicate", "unique"):
        counts = df.filter(x.isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
        joined = join_alike(df, counts, [*by, column])
        test = F.col("_n") > 1 if kind == "duplicate" else F.col("_n") == 1
        return joined.withColumn(into, F.coalesce(test, F.lit(False))).drop("_n").select(*df.columns, into)
    if kind in ("above", "below"):
        bound = df.groupBy(*by).agg(F.avg(column).alias("_bound"))
        test = x > F.col("_bound") if kind == "above" else x < F.col("_bound")
    else:
        order = F.desc(column) if kind == "top" else F.asc(column)
        if by:
            ranked = df.filter(x.isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("_r") <= n)
        else:
            ranked = df.filter(x.isNotNull()).orderBy(order).limit(n)
        bound = ranked.groupBy(*by).agg((F.min(column) if kind == "top" else F.max(column)).alias("_bound"))
        test = x >= F.col("_bound") if kind == "top" else x <= F.col("_bound")
    joined = join_alike(df, bound, by) if by else df.withColumn("_bound", bound.scalar())
    return joined.withColumn(into, F.coalesce(test, F.lit(False))).select(*df.columns, into)


def color_scale(df: DataFrame, column: str, stops: Sequence[str], by: Sequence[str] = (), into: str = "color") -> DataFrame:
    """Hex colour by position between the smallest and the largest value; 2 or 3 stops; a flat range sits in the middle."""
    ends = df.groupBy(*by).agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    joined = join_alike(df, ends, by) if by else df.withColumns({c: ends.select(c).scalar() for c in ("_lo", "_hi")})
    at = F.when(F.col("_hi") == F.col("_lo"), F.lit(0.5)).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    parts = [[int(s.lstrip("#")[k : k + 2], 16) for k in (0, 2, 4)] for s in stops]

    def blend(a: list[int], b: list[int], t: Column) -> Column:
        return F.concat(F.lit("#"), *[F.lpad(F.hex(F.round(F.lit(float(x)) + t * float(y - x)).cast("int")), 2, "0") for x, y in zip(a, b)])

    if len(parts) == 2:
        shade = blend(parts[0], parts[1], at)
    else:
        shade = F.when(at <= 0.5, blend(parts[0], parts[1], at * 2)).otherwise(blend(parts[1], parts[2], at * 2 - 1))
    return joined.withColumn(into, F.when(F.col(column).isNotNull(), shade)).select(*df.columns, into)


def find_cells(cells: DataFrame, query: str, match_case: bool = False, in_formulas: bool = False, order: Sequence[str] = ("sheet_id", "row", "col")) -> DataFrame:
    """Cells whose shown value (or formula) holds the text, in reading order."""
    from .cells import shown

    text = F.coalesce(F.col("f"), shown()) if in_formulas else shown()
    test = text.contains(query) if match_case else F.lower(text).contains(query.lower())
    return cells.filter(F.coalesce(test, F.lit(False))).orderBy(*order)


def replace_cells(cells: DataFrame, query: str, new: str, match_case: bool = False) -> DataFrame:
    """Literal replacement in values, typed again; formulas stay as they are."""
    from .cells import shown

    pattern = ("" if match_case else "(?i)") + rf"\Q{query}\E"
    text = F.regexp_replace(shown(), pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    hit = F.col("f").isNull() & F.coalesce(shown().rlike(pattern), F.lit(False))
    typed = infer(text)
    keep = lambda name, value: F.when(hit, value).otherwise(F.col(name)).alias(name)
    changed = {"v_num": typed["num"], "v_str": typed["str"], "v_bool": typed["bool"], "t": typed["t"]}
    return cells.select(*[keep(c, changed[c]) if c in changed else F.col(c) for c in cells.columns])
