"""Errors as values: codes, safe arithmetic, logic and value questions.

A failed computation is NULL; `with_error` puts the code in a column beside it when the
caller wants to know why.  Element-wise forms work on arrays of equal length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The error codes and their numbers.
ERROR_NUMBERS = {
    "#DIV/0!": 2,
    "#VALUE!": 3,
    "#REF!": 4,
    "#NAME?": 5,
    "#NUM!": 6,
    "#N/A": 7,
}
OTHER_ERRORS = ("#CIRC!", "#SPILL!")
ALL_ERRORS = (*ERROR_NUMBERS, *OTHER_ERRORS)


def finite(x: Column) -> Column:
    """A double, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def num(x: Column) -> Column:
    """A numeric operand: blank counts as 0."""
    return F.coalesce(x.cast("double"), F.lit(0.0))


def add(a: Column, b: Column) -> Column:
    return num(a) + num(b)


def subtract(a: Column, b: Column) -> Column:
    return num(a) - num(b)


def multiply(a: Column, b: Column) -> Column:
    return num(a) * num(b)


def divide(a: Column, b: Column) -> Column:
    """NULL (#DIV/0!) for a zero divisor."""
    return F.try_divide(num(a), num(b))


def power(a: Column, b: Column) -> Column:
    """NULL (#NUM!) where the result is not finite."""
    return finite(F.pow(num(a), num(b)))


def percent(a: Column) -> Column:
    return num(a) / 100


def concat(*parts: Column) -> Column:
    """Blank parts are empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def divide_error(a: Column, b: Column) -> Column:
    return F.when(num(b) == 0, F.lit("#DIV/0!"))


def power_error(a: Column, b: Column) -> Column:
    return F.when(power(a, b).isNull(), F.lit("#NUM!"))


def elementwise(a: Column, b: Column, operation) -> Column:
    """Arrays of equal length element by element; NULL (#N/A) where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, operation))


def if_(condition: Column, then: Column | None = None, otherwise: Column | None = None) -> Column:
    """A missing branch gives the condition itself; a blank condition is false."""
    known = F.coalesce(condition, F.lit(False))
    return F.when(known, known if then is None else then).otherwise(known if otherwise is None else otherwise)


def ifs(*pairs: tuple[Column, Column]) -> Column:
    """Value of the first true condition; NULL (#N/A) if none."""
    return reduce(lambda out, pair: F.when(pair[0], pair[1]).otherwise(out), reversed(pairs), F.lit(None))


def switch(value: Column, *cases: tuple[Column, Column], default: Column | None = None) -> Column:
    return reduce(lambda out, case: F.when(value.eqNullSafe(case[0]), case[1]).otherwise(out), reversed(cases), F.lit(None) if default is None else default)


def choose(index: Column, *values: Column) -> Column:
    """1-based; outside the list NULL (#VALUE!)."""
    return F.get(F.array(*values), (F.floor(index) - 1).cast("int"))


def if_error(value: Column, fallback: Column, error: Column | None = None) -> Column:
    """Fallback where the value failed: NULL, or a code in the error column."""
    return F.coalesce(value, fallback) if error is None else F.when(error.isNotNull(), fallback).otherwise(value)


def if_na(value: Column, error: Column, fallback: Column) -> Column:
    return F.when(error == "#N/A", fallback).otherwise(value)


def and_(*parts: Column) -> Column:
    """Blanks are skipped; all blank gives NULL (#VALUE!)."""
    return F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(True)) for p in parts]))


def or_(*parts: Column) -> Column:
    return F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts]))


def xor_(*parts: Column) -> Column:
    """True for an odd number of true parts."""
    return sum(F.coalesce(p, F.lit(False)).cast("int") for p in parts) % 2 == 1


def is_error(text: Column) -> Column:
    return F.coalesce(text.isin(*ALL_ERRORS), F.lit(False))


def is_err(text: Column) -> Column:
    """Any error but #N/A."""
    return is_error(text) & (text != "#N/A")


def is_na(text: Column) -> Column:
    return F.coalesce(text == "#N/A", F.lit(False))


def error_number(text: Column) -> Column:
    return reduce(lambda out, e: F.when(text == e[0], F.lit(e[1])).otherwise(out), ERROR_NUMBERS.items(), F.lit(None).cast("int"))


def is_blank(text: Column) -> Column:
    return text.isNull() | (text.cast("string") == "")


def is_even(x: Column) -> Column:
    return F.floor(F.abs(num(x))) % 2 == 0


def is_odd(x: Column) -> Column:
    return F.floor(F.abs(num(x))) % 2 == 1


def type_number(tag: Column) -> Column:
    """1 number or date, 2 text, 4 boolean, 16 error; a blank counts as a number."""
    return F.when(tag == "s", 2).when(tag == "b", 4).when(tag == "e", 16).otherwise(1)
