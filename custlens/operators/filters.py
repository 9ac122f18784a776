"""Report filters and the filter option lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.config import Params

# Fixed value: the option that disables a list filter.
ALL = "All"


def filter_date_range(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """inclusive day range on ``Date``; rows without a date are dropped."""
    return df.where(F.col("Date").between(F.lit(start), F.lit(end)))


def filter_in(df: DataFrame, column: str, selected: Sequence[str]) -> DataFrame:
    """Keep rows whose ``column`` is in ``selected``.

    An empty selection or one containing "All" keeps everything.
    """
    selected = list(selected)
    if not selected or ALL in selected:
        return df
    return df.where(F.col(column).isin(selected))


def apply_filters(df: DataFrame, params: Params) -> DataFrame:
    """date range, then region, shipping method and customer name."""
    df = filter_date_range(df, params.start, params.end)
    df = filter_in(df, "RegionName", params.regions)
    df = filter_in(df, "ShippingMethodName", params.shipping_methods)
    return filter_in(df, "CustomerName", params.customers)


def filter_options(date_filtered: DataFrame) -> DataFrame:
    """distinct non-null regions, shipping methods and customer names.

    The rows are reduced to their distinct (region, method, customer) triples before each
    of those emits its three (Field, Value) pairs, which a second distinct reduces.
    The lists come from the date-filtered data only and do not cascade; they
    are sorted (a distributed sort: the customer list grows with the data).
    """
    pairs = F.explode(F.array(
        F.struct(F.lit("RegionName").alias("Field"), F.col("RegionName").alias("Value")),
        F.struct(F.lit("ShippingMethodName").alias("Field"), F.col("ShippingMethodName").alias("Value")),
        F.struct(F.lit("CustomerName").alias("Field"), F.col("CustomerName").alias("Value")),
    )).alias("opt")
    return (
        date_filtered.select("RegionName", "ShippingMethodName", "CustomerName").distinct().select(pairs)
        .select("opt.Field", "opt.Value")
        .where(F.col("Value").isNotNull())
        .distinct()
        .orderBy("Field", "Value")
    )
