"""String helpers."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StringType,
)

# Every code point Python's ``str.strip()`` removes, derived from ``str.isspace``
# (includes U+001C..U+001F and U+0085, which the Java ``\s`` class does not).
_PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
assert sys.maxunicode >= 0x3000

# Fixed value: separator between category and product in product names
# (space, EN DASH U+2013, space).  A plain hyphen does not split.
CATEGORY_SEPARATOR = " – "


def py_strip(col: Column) -> Column:
    """Strip leading/trailing whitespace like Python ``str.strip()``.

    ``btrim`` with an explicit character set stays inside whole-stage codegen,
    unlike a regular expression.
    """
    return F.btrim(col, F.lit(_PY_WHITESPACE))


def normalize_key(col: Column, dtype: DataType) -> Column:
    """Join key as a stripped string; nulls stay null.

    Integral values are written without a fraction ('3', never '3.0'), also when
    they arrive as whole floating-point numbers.  NaN is no key (null); a number
    beyond the integers keeps its own text.
    """
    if isinstance(dtype, StringType):
        return py_strip(col)
    if isinstance(dtype, IntegralType):
        return col.cast("bigint").cast("string")
    if isinstance(dtype, (DoubleType, FloatType, DecimalType)):
        number = F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        as_long = (col if isinstance(dtype, DecimalType) else number).try_cast("bigint")
        whole = as_long.cast("double") == number
        return F.when(whole, as_long.cast("string")).otherwise(F.when(number.isNotNull(), col.cast("string")))
    return py_strip(col.cast("string"))


def product_category(name: Column) -> Column:
    """Text before the first separator, or the whole name when it has none."""
    return F.substring_index(name, CATEGORY_SEPARATOR, 1)
