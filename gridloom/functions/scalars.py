"""Scalar functions over columns: text, fixed formats, dates, mathematics.

Positions are 1-based and count code points; a result outside a function's domain is NULL.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# text ------------------------------------------------------------------------------


def left(text: Column, n: Column) -> Column:
    return F.when(n >= 0, F.left(text, n))


def right(text: Column, n: Column) -> Column:
    return F.when(n > 0, F.right(text, n)).when(n == 0, F.lit(""))


def mid(text: Column, start: Column, n: Column) -> Column:
    return F.when((start >= 1) & (n >= 0), F.substring(text, start, n))


def rept(text: Column, n: Column) -> Column:
    """NULL (#VALUE!) for a negative count or over 32,768 bytes."""
    return F.when((n >= 0) & (F.octet_length(text) * n <= 32768), F.repeat(text, n.cast("int")))


def code(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.ascii(text))


def char(n: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")


def exact(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def proper(text: Column) -> Column:
    """First letter of each space-separated word large, the rest small."""
    return F.initcap(text)


def trim(text: Column) -> Column:
    """Outer blanks go; inner runs become one."""
    return F.regexp_replace(F.trim(text), " +", " ")


def clean(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x1F]", "")


def substitute(text: Column, old: str, new: str, nth: int | None = None) -> Column:
    """All occurrences, or the n-th only."""
    if nth is None:
        return F.replace(text, F.lit(old), F.lit(new))
    parts = F.split(text, rf"\Q{old}\E", -1)
    join = lambda x: F.array_join(x, old)
    return F.when(F.size(parts) > nth, F.concat(join(F.slice(parts, 1, nth)), F.lit(new), join(F.slice(parts, F.lit(nth + 1), F.size(parts))))).otherwise(text)


def find(part: Column, text: Column, start: int = 1) -> Column:
    at = F.locate if isinstance(part, str) else None
    found = at(part, text, start) if at else F.position(part, text, F.lit(start))
    return F.when(found > 0, found)


def search(part: Column, text: Column, start: int = 1) -> Column:
    """find without case; no wildcards."""
    return find(F.lower(part), F.lower(text), start)


def replace_at(text: Column, start: Column, n: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start - 1), new, F.substring(text, start + n, F.length(text)))


def text_before(text: Column, mark: str, nth: int = 1) -> Column:
    """Text before the n-th mark, counted from the end if negative; NULL (#N/A) if there is none."""
    parts = F.split(text, rf"\Q{mark}\E", -1)
    keep = F.lit(nth) if nth > 0 else F.size(parts) + nth
    return F.when((F.size(parts) > abs(nth)), F.array_join(F.slice(parts, F.lit(1), keep), mark))


def text_after(text: Column, mark: str, nth: int = 1) -> Column:
    parts = F.split(text, rf"\Q{mark}\E", -1)
    first = F.lit(nth + 1) if nth > 0 else F.size(parts) + nth + 1
    return F.when(F.size(parts) > abs(nth), F.array_join(F.slice(parts, first, F.size(parts)), mark))


def hyperlink(url: Column, label: Column | None = None) -> Column:
    return url if label is None else F.coalesce(label, url)


# formats ---------------------------------------------------------------------------


#: Below the first of these a double's nearest decimal names its digits up to the cent, below the second it may have a fraction, below the third its digits fit a decimal.
CENTS, FRACTIONS, DIGITS = 2.0**46, 2.0**53, 2.0**120


def _shown(x: Column, decimals: int) -> Column:
    """A rounded double with commas, by its exact digits, as SQL writes it: -0.00, nan, inf and -inf too.

    From DIGITS (1.3e36) on, zeros follow the 17 digits that name the double."""
    size = F.abs(x)
    rest = size % 1.0
    whole = size - rest
    high = F.floor(whole / 2.0**60)
    few = min(max(decimals, 0), 6)  # a number of CENTS or more has no more digits than these
    cents = F.floor(size).cast("decimal(20,0)") + (F.rint(rest * 10.0**few) / 10.0**few).cast("decimal(8,6)")
    large = high.cast("decimal(19,0)") * F.lit(Decimal(2**60)) + F.floor(whole - high.cast("double") * 2.0**60).cast("decimal(19,0)")
    exact = F.when(size < FRACTIONS, F.format_number(cents, decimals)).otherwise(F.format_number(large, decimals))
    minus = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    special = F.when(F.isnan(x), F.lit("nan")).when(size == float("inf"), F.concat(minus, F.lit("inf")))
    return special.when((size >= CENTS) & (size < DIGITS), F.concat(minus, exact)).otherwise(F.format_number(x, decimals))


def fixed(x: Column, decimals: int = 2, commas: bool = True) -> Column:
    shown = _shown(round_half_away(x, decimals), decimals)
    return shown if commas else F.replace(shown, F.lit(","), F.lit(""))


def dollar(x: Column, decimals: int = 2) -> Column:
    """Negative amounts in brackets."""
    shown = F.concat(F.lit("$"), _shown(F.abs(round_half_away(x, decimals)), decimals))
    return F.when(round_half_away(x, decimals) < 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)


def text(x: Column, pattern: str) -> Column:
    """A fixed list of patterns: 0, 0.00, #,##0, #,##0.00, 0%, 0.0%, 0.00%, yyyy-mm-dd and money signs before numbers.

    A number below 0 keeps its minus where it is rounded to 0, and so does a zero below 0."""
    if pattern.startswith("yyyy"):
        return F.date_format(x, pattern.replace("mm", "MM"))
    sign = pattern[0] if pattern[0] in "₩$€£¥" else ""
    bare = pattern.removeprefix(sign)
    decimals = len(bare.rstrip("%").partition(".")[2])
    value = x * 100 if bare.endswith("%") else x
    shown = F.concat(fixed(value, decimals, "," in bare), F.lit("%" if bare.endswith("%") else ""))
    return F.when(shown.startswith("-"), F.concat(F.lit(f"-{sign}"), shown.substr(2, 1_000))).otherwise(F.concat(F.lit(sign), shown)) if sign else shown


def format_stat(x: Column, is_percent: Column | bool = False) -> Column:
    """Two decimals, or one with a percent sign."""
    flag = is_percent if isinstance(is_percent, Column) else F.lit(is_percent)
    return F.when(flag, F.concat(fixed(x * 100, 1), F.lit("%"))).otherwise(fixed(x, 2))


# dates -----------------------------------------------------------------------------


def serial_to_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))


def date_to_serial(day: Column) -> Column:
    return F.datediff(day, F.lit("1899-12-30").cast("date"))


def date(year: Column, month: Column, day: Column) -> Column:
    """Months and days overflow; years 0 to 99 are 1900 to 1999."""
    full = F.when(year < 100, year + 1900).otherwise(year).cast("int")
    return F.date_add(F.add_months(F.make_date(full, F.lit(1), F.lit(1)), (month - 1).cast("int")), (day - 1).cast("int"))


def weekday(day: Column) -> Column:
    return F.dayofweek(day)


def weeknum(day: Column) -> Column:
    """Week of the year, weeks begin on Sunday, 1 January in week 1."""
    first = F.trunc(day, "year")
    return F.floor((F.dayofyear(day) + F.dayofweek(first) - 2) / 7).cast("int") + 1


def isoweeknum(day: Column) -> Column:
    return F.weekofyear(day)


def time(hour: Column, minute: Column, second: Column) -> Column:
    """Fraction of a day, wrapping at 24 hours."""
    total = hour * 3600 + minute * 60 + second
    return F.pmod(total, F.lit(86400)) / 86400.0


def hms(fraction: Column) -> tuple[Column, Column, Column]:
    """Hour, minute and second of a day fraction."""
    seconds = F.pmod(F.round((fraction - F.floor(fraction)) * 86400), F.lit(86400)).cast("int")
    return F.floor(seconds / 3600).cast("int"), F.floor(seconds / 60).cast("int") % 60, seconds % 60


def edate(day: Column, months: Column) -> Column:
    return F.add_months(day, months)


def eomonth(day: Column, months: Column) -> Column:
    return F.last_day(F.add_months(day, months))


def _full_months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - F.when(F.day(b) < F.day(a), 1).otherwise(0)


def datedif(a: Column, b: Column, unit: str) -> Column:
    """Units D M Y YM MD YD; NULL (#NUM!) if the end is before the start."""
    months = _full_months(a, b)
    if unit == "D":
        out = F.datediff(b, a)
    elif unit == "M":
        out = months
    elif unit == "Y":
        out = F.floor(months / 12).cast("int")
    elif unit == "YM":
        out = months % 12
    elif unit == "MD":
        # days since the last monthly anniversary; a day the month lacks overflows into the next
        before = F.add_months(F.trunc(b, "month"), -1)
        out = F.when(F.day(b) >= F.day(a), F.day(b) - F.day(a)).otherwise(F.datediff(b, F.date_add(before, F.day(a) - 1)))
    elif unit == "YD":
        same = F.date_add(F.add_months(F.trunc(a, "month"), (F.floor(months / 12) * 12).cast("int")), F.day(a) - 1)
        out = F.datediff(b, same)
    else:
        raise ValueError(unit)
    return F.when(b >= a, out)


def days360(a: Column, b: Column, european: bool = False) -> Column:
    d1, d2 = F.day(a), F.day(b)
    if european:
        d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
    else:
        start_end = a == F.last_day(a)
        d1 = F.when(start_end | (d1 == 31), 30).otherwise(d1)
        d2 = F.when((d2 == 31) & (d1 == 30), 30).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def yearfrac(a: Column, b: Column, basis: int = 0) -> Column:
    """Bases: 0 30/360, 1 actual/actual, 2 actual/360, 3 actual/365, 4 European 30/360."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    if basis in (0, 4):
        return days360(lo, hi, basis == 4) / 360.0
    days = F.datediff(hi, lo)
    if basis == 1:
        first, last = F.trunc(lo, "year"), F.add_months(F.trunc(hi, "year"), 12)
        return days / (F.datediff(last, first) / (F.year(hi) - F.year(lo) + 1))
    return days / (360.0 if basis == 2 else 365.0)


# mathematics -----------------------------------------------------------------------


def inside(ok: Column, value: Column) -> Column:
    """The value where it is defined, else NULL (#NUM!)."""
    return F.when(ok, value)


def sqrt(x: Column) -> Column:
    return inside(x >= 0, F.sqrt(x))


def ln(x: Column) -> Column:
    return inside(x > 0, F.log(x))


def log(x: Column, base: Column | float = 10.0) -> Column:
    b = base if isinstance(base, Column) else F.lit(float(base))
    return inside((x > 0) & (b > 0) & (b != 1), F.log(x) / F.log(b))


def atan2(x: Column, y: Column) -> Column:
    """x comes first."""
    return inside((x != 0) | (y != 0), F.atan2(y, x))


def arc(x: Column, of) -> Column:
    """asin, acos within -1 to 1."""
    return inside(F.abs(x) <= 1, of(x))


def acosh(x: Column) -> Column:
    return inside(x >= 1, F.acosh(x))


def atanh(x: Column) -> Column:
    return inside(F.abs(x) < 1, F.atanh(x))


def product_of(first: Column, last: Column, step: int = 1) -> Column:
    return F.when(last >= first, F.aggregate(F.sequence(first.cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint")), F.lit(1.0), lambda a, x: a * x)).otherwise(F.lit(1.0))


def fact(x: Column) -> Column:
    n = F.floor(x)
    return F.when((n >= 0) & (n <= 170), product_of(F.lit(1), n))


def factdouble(x: Column) -> Column:
    n = F.floor(x)
    return F.when((n >= -1) & (n <= 300), product_of(F.when(n % 2 == 0, F.lit(2)).otherwise(F.lit(1)), n, 2))


def permut(n: Column, k: Column) -> Column:
    a, b = F.floor(n), F.floor(k)
    return F.when((a >= 0) & (b >= 0) & (b <= a), product_of(a - b + 1, a))


def combin(n: Column, k: Column) -> Column:
    a, b = F.floor(n), F.floor(k)
    low = F.least(b, a - b)
    return F.when((b >= 0) & (b <= a), F.aggregate(F.when(low >= 1, F.sequence(F.lit(1).cast("bigint"), low.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), F.lit(1.0), lambda acc, i: F.round(acc * (a - low + i) / i)))


def base(n: Column, radix: int, width: int = 0) -> Column:
    shown = F.conv(F.floor(n).cast("string"), 10, radix)
    return F.when(n >= 0, F.when(F.length(shown) < width, F.lpad(shown, width, "0")).otherwise(shown) if width else shown)


def decimal(text: Column, radix: int) -> Column:
    return F.conv(text, radix, 10).cast("bigint")


def round_half_away(x: Column, digits: int = 0) -> Column:
    """Rounded in the arithmetic of doubles, as SQL rounds them: shifted by the digits, rounded to a whole number, shifted back.

    A number below 0 keeps its minus where it is rounded to 0, and so does a zero below 0."""
    x = x.cast("double")
    if digits < 0:
        return F.round(x, digits)
    k = float(10**digits)
    # the sign of a zero is a zero of that sign
    return F.when(F.abs(x) * k < float("inf"), F.round(F.abs(x) * k) / k * F.signum(x)).otherwise(x)


def _scaled(x: Column, digits: int, of) -> Column:
    k = float(10**digits)
    return of(F.round(F.abs(x) * k, 9)) / k * F.signum(x)


def roundup(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, F.ceil)


def rounddown(x: Column, digits: int = 0) -> Column:
    return _scaled(x, digits, F.floor)


def mod(x: Column, y: Column) -> Column:
    """Sign of the divisor; NULL (#DIV/0!) for 0."""
    return F.when(y != 0, x - y * F.floor(x / F.nullif(y, F.lit(0.0))))


def quotient(x: Column, y: Column) -> Column:
    return F.when(y != 0, rounddown(x / F.nullif(y, F.lit(0.0))))


def ceiling(x: Column, step: Column) -> Column:
    """A step of 0 gives 0; a positive number with a negative step is NULL (#NUM!)."""
    safe = F.nullif(step, F.lit(0.0))
    return F.when(step == 0, F.lit(0.0)).when(~((x > 0) & (step < 0)), F.ceil(F.round(x / safe, 9)) * step)


def floor(x: Column, step: Column) -> Column:
    """A step of 0 is NULL (#DIV/0!)."""
    safe = F.nullif(step, F.lit(0.0))
    return F.when((step != 0) & ~((x > 0) & (step < 0)), F.floor(F.round(x / safe, 9)) * step)


def mround(x: Column, step: Column) -> Column:
    """Nearest multiple, half away from zero; signs must agree."""
    safe = F.nullif(step, F.lit(0.0))
    return F.when(step == 0, F.lit(0.0)).when(x * step >= 0, F.round(x / safe) * step)


def even(x: Column) -> Column:
    return F.signum(x) * F.ceil(F.abs(x) / 2) * 2


def odd(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.signum(x) * (F.ceil((F.abs(x) - 1) / 2) * 2 + 1))


def rand_between(low: int, high: int, seed: int | None = None) -> Column:
    return F.floor(F.rand(seed) * (high - low + 1)).cast("bigint") + low
