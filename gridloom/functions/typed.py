"""Typed cells: text to values, values to numbers and text, and an order over mixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
PERCENT = r"^[+-]?[0-9,]*\.?[0-9]+%$"
MONEY = r"^[-+]?[₩$€£¥] ?[0-9][0-9,]*(\.[0-9]+)?$"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, "[,₩$€£¥% ]", "").try_cast("double")


def _date(text: Column) -> Column:
    part = lambda n: F.regexp_extract(text, r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})$", n)
    return F.when(text.rlike(DATE), F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")).try_cast("date"))


def infer(text: Column) -> Column:
    """struct(t, num, str, bool, fmt) of a typed-in text: TRUE/FALSE, percent, money, numbers, ISO dates, else text; blank is all NULL."""
    x = F.trim(text)
    date = _date(x)
    serial = F.datediff(date, F.lit("1899-12-30").cast("date")).cast("double")
    made = lambda t, num=None, s=None, b=None, fmt=None: F.struct(
        F.lit(t).cast("string").alias("t"),
        (F.lit(None).cast("double") if num is None else num.cast("double")).alias("num"),
        (F.lit(None).cast("string") if s is None else s).alias("str"),
        (F.lit(None).cast("boolean") if b is None else b).alias("bool"),
        (F.lit(None).cast("string") if fmt is None else fmt).alias("fmt"),
    )
    decimals = lambda yes, no: F.when(x.contains("."), F.lit(yes)).otherwise(F.lit(no))
    return (
        F.when(text.isNull() | (x == ""), made(None))
        .when(F.upper(x).isin("TRUE", "FALSE"), made("b", b=F.upper(x) == "TRUE"))
        .when(x.rlike(PERCENT), made("n", num=_number(x) / 100, fmt=decimals("0.00%", "0%")))
        .when(x.rlike(MONEY), made("n", num=_number(x), fmt=F.concat(F.regexp_extract(x, "[₩$€£¥]", 0), decimals("#,##0.00", "#,##0"))))
        .when(x.rlike(GROUPED), made("n", num=_number(x), fmt=decimals("#,##0.00", "#,##0")))
        .when(x.rlike(PLAIN), made("n", num=x.try_cast("double")))
        .when(date.isNotNull(), made("d", num=serial, fmt=F.lit("yyyy-mm-dd")))
        .otherwise(made("s", s=text))
    )


def infer_cell_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each named text column becomes a struct of its typed value."""
    return df.withColumns({c: infer(F.col(c)) for c in columns})


def to_number(text: Column) -> Column:
    """Blank is 0; commas are dropped; a percent sign divides by 100; bad text is NULL (#VALUE!)."""
    x = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(x, ",", ""), "%$", "").try_cast("double")
    return F.when(text.isNull() | (x == ""), F.lit(0.0)).when(x.endswith("%"), plain / 100).otherwise(plain)


def number_value(text: Column, decimal: str = ".", group: str = ",") -> Column:
    """to_number with its own decimal and group marks."""
    return to_number(F.replace(F.replace(text, F.lit(group), F.lit("")), F.lit(decimal), F.lit(".")))


def n_of(value: Column, tag: Column) -> Column:
    """Numbers and dates as they are, booleans as 1 and 0, everything else 0."""
    return F.when(tag.isin("n", "d", "b"), F.coalesce(value.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))


def t_of(value: Column, tag: Column) -> Column:
    """Text as it is, else empty."""
    return F.when(tag == "s", F.coalesce(value, F.lit(""))).otherwise(F.lit(""))


def to_text(number: Column) -> Column:
    """A number as shown: whole numbers without a point."""
    x = number.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), "").when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def to_boolean(text: Column) -> Column:
    """TRUE/FALSE in any case; a number is true unless 0; anything else NULL."""
    x = F.upper(F.trim(text))
    return F.when(x == "TRUE", True).when(x == "FALSE", False).otherwise(x.try_cast("double") != 0)


def mixed_key(number: Column, text: Column) -> Column:
    """Sort and equality key: numbers and booleans before text, text without case."""
    return F.struct(number.isNull().alias("is_text"), F.coalesce(number.cast("double"), F.lit(0.0)).alias("num"), F.when(number.isNull(), F.lower(F.coalesce(text, F.lit("")))).otherwise("").alias("str"))
