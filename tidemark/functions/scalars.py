"""Scalar column expressions with the library's null rules.

NaN becomes null on read; a ratio over zero is null; the larger or smaller of two columns is null if either is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A Monday; weekdays are counted from it.
MONDAY = "1969-12-29"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x: Column | str) -> Column:
    """Null in place of NaN."""
    return F.when(~F.isnan(col(x)), col(x))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null over zero."""
    return F.try_divide(col(a), col(b))


def larger(a: Column | str, b: Column | str) -> Column:
    """The larger of two columns, null if either is."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.greatest(col(a), col(b)))


def smaller(a: Column | str, b: Column | str) -> Column:
    """The smaller of two columns, null if either is."""
    return F.when(col(a).isNotNull() & col(b).isNotNull(), F.least(col(a), col(b)))


def round_even(x: Column | str, digits: int) -> Column:
    """Half-to-even rounding."""
    return F.bround(col(x), digits)


def _weekdays_to(day: Column) -> Column:
    """Mondays to Fridays from MONDAY up to but not on a day."""
    n = F.datediff(day, F.to_date(F.lit(MONDAY)))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(first: Column | str, last: Column | str) -> Column:
    """Mondays to Fridays from first to last, both counted; null if either is."""
    return (_weekdays_to(F.date_add(col(last), 1)) - _weekdays_to(col(first))).cast("long")


def rescale_from_min(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Map [low, high] onto a range from ``to_low`` up. Where high / low is under to_high / to_low the range
    shrinks to that ratio; a constant input maps to ``to_low``."""
    times = ratio(high, low)
    top = F.when(times < to_high / to_low, times * to_low).otherwise(F.lit(float(to_high)))
    return F.when(high == low, F.lit(float(to_low))).otherwise(to_low + ratio(x - low, high - low) * (top - to_low))


def rescale_from_max(x: Column, low: Column, high: Column, to_low: float, to_high: float) -> Column:
    """Map [low, high] onto a range from ``to_high`` down, shrunk likewise; a constant input maps to ``to_high``."""
    times = ratio(high, low)
    bottom = F.when(times < to_high / to_low, ratio(F.lit(float(to_high)), times)).otherwise(F.lit(float(to_low)))
    return F.when(high == low, F.lit(float(to_high))).otherwise(bottom + ratio(x - low, high - low) * (to_high - bottom))


def renormalize(x: Column | str, from_low: float, from_high: float, to_low: float, to_high: float) -> Column:
    """Map one range onto another linearly."""
    return to_low + ratio(col(x) - from_low, F.lit(float(from_high - from_low))) * (to_high - to_low)


def field_or_zero(x: Column | str, *path: str) -> Column:
    """A number inside nested structs, 0 where any step is missing."""
    found = col(x)
    for name in path:
        found = found.getField(name)
    return F.coalesce(found, F.lit(0))
