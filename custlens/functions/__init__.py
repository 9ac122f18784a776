"""Column-expression helpers.  All are built-in Spark expressions (no Python UDFs)."""

from custlens.functions.dates import (
    elapsed_days,
    month_end,
    month_start,
    to_date_tolerant,
    to_timestamp_tolerant,
    weekday_name,
)
from custlens.functions.numeric import clip_lower, rint2, safe_divide, to_double
from custlens.functions.text import normalize_key, product_category, py_strip

__all__ = [
    "clip_lower",
    "elapsed_days",
    "month_end",
    "month_start",
    "normalize_key",
    "product_category",
    "py_strip",
    "rint2",
    "safe_divide",
    "to_date_tolerant",
    "to_double",
    "to_timestamp_tolerant",
    "weekday_name",
]
