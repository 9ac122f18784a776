"""Date and timestamp helpers (timestamps are zone-less: ``TIMESTAMP_NTZ``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType


def to_timestamp_tolerant(col: Column, dtype: DataType | None = None) -> Column:
    """Timestamp without zone; unparseable text becomes null instead of failing."""
    if isinstance(dtype, TimestampNTZType):
        return col
    if isinstance(dtype, (TimestampType, DateType)):
        return col.cast("timestamp_ntz")
    if isinstance(dtype, StringType) or dtype is None:
        return F.trim(col).try_cast("timestamp_ntz")
    return col.try_cast("timestamp_ntz")


def to_date_tolerant(col: Column, dtype: DataType | None = None) -> Column:
    """Calendar day of a timestamp (midnight normalisation); bad input -> null."""
    if isinstance(dtype, DateType):
        return col
    return F.to_date(to_timestamp_tolerant(col, dtype))


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole elapsed days from ``start`` to ``end`` (23:00 -> 01:00 next day is 0).

    Truncates toward zero; callers clip negatives to 0, where truncation and
    flooring agree.
    """
    return F.timestamp_diff("DAY", start, end)


def month_start(d: Column) -> Column:
    return F.trunc(d, "month")


def month_end(d: Column) -> Column:
    return F.last_day(d)


def weekday_name(d: Column) -> Column:
    """English day name, e.g. 'Monday'."""
    return F.date_format(d, "EEEE")


def weekday_index(d: Column) -> Column:
    """0 = Monday ... 6 = Sunday (sort key for weekday reports)."""
    return F.weekday(d)
