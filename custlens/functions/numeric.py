"""Numeric helpers with the null/NaN rules of the analysed application."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

# Strings a tolerant numeric parse accepts (decimal, exponent, inf, nan).
# Spark's own cast also takes Java suffixes like '1d'; those must become 0.
_NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def to_double(col: Column, dtype: DataType | None = None) -> Column:
    """Parse to double; unparseable, null and NaN all become 0.0."""
    if dtype is None or isinstance(dtype, NumericType):
        parsed = col.cast("double")
    elif isinstance(dtype, StringType):
        parsed = F.when(col.rlike(_NUMERIC_TEXT), F.trim(col).try_cast("double"))
    else:
        parsed = col.try_cast("double")
    return F.coalesce(F.nanvl(parsed, F.lit(None).cast("double")), F.lit(0.0))


# Sums count in billionths, exactly, for values below EXACT_LIMIT (10^12 of them fit).
UNITS = 1e9
EXACT_LIMIT = 1e17


def exact_units(col: Column) -> Column:
    """A double in billionths as a decimal (half-even); null if null, huge, infinite or NaN."""
    return F.when(F.abs(col) < EXACT_LIMIT, F.rint(col * UNITS).cast("decimal(38,0)"))


def inexact_rest(col: Column) -> Column:
    """The double itself where :func:`exact_units` can't hold it, else null."""
    return F.when(~(F.abs(col) < EXACT_LIMIT) | F.isnan(col), col)


# Below this, billionths are whole doubles (2^53), which two bigints take exactly; each
# part leaves room for the sums of 10^10 rows.
_SMALL = 9e6
_PART = 2 ** 29


def exact_sum(col: Column) -> Column:
    """Sum of doubles whose digits don't depend on the order of the rows.

    A sum of doubles rounds at every step, so other partitions give other last digits
    and may flip ties in a rank.  Here every value counts in billionths, which are summed
    exactly: as two bigints, for a decimal made of each row's double would take most of
    the time of an aggregation, and as decimals from nine millions on.  Values that don't
    fit (10^17 and more, infinite) are added as doubles.  Null without a value, as ``sum``.
    """
    small = F.when(F.abs(col) < _SMALL, F.rint(col * UNITS))
    parts = (small / float(_PART)).cast("bigint")
    high, low = F.sum(parts), F.sum((small - parts.cast("double") * float(_PART)).cast("bigint"))
    large = F.sum(exact_units(F.when(F.abs(col) >= _SMALL, col)))
    rest = F.sum(inexact_rest(col))
    short = large.isNull() & (F.abs(high) < 2 ** 32) & (F.abs(low) < 2 ** 61)
    wide = high.cast("decimal(20,0)") * F.lit(_PART).cast("decimal(9,0)") + low.cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    units = F.when(short, (high * F.lit(_PART) + low).cast("double")).when(
        large.isNotNull() | wide.isNotNull(), (F.coalesce(wide, zero) + F.coalesce(large, zero)).cast("double"))
    total = units / UNITS
    return F.when(rest.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + rest)


def rint2(col: Column) -> Column:
    """Round to 2 decimals half-to-even on the scaled double (numpy's ``round(2)``)."""
    return F.rint(col * 100) / 100


def clip_lower(col: Column, lower) -> Column:
    """``max(col, lower)`` that keeps nulls null (``greatest`` would not)."""
    return F.when(col < lower, F.lit(lower)).otherwise(col)


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Division where a zero or null denominator gives null, never an error."""
    return F.try_divide(numerator, F.when(denominator != 0, denominator))
