"""Weekday revenue and customer histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.dates import weekday_index, weekday_name
from custlens.functions.numeric import exact_sum
from custlens.operators.ordering import histogram
from custlens.plans.common import sort_bounded

MAX_BINS = 20


def weekday_revenue(df: DataFrame) -> DataFrame:
    """Revenue per day of the week, Monday first; days without lines are absent."""
    g = df.groupBy(
        weekday_name(F.col("Date")).alias("Weekday"), weekday_index(F.col("Date")).alias("_idx")
    ).agg(exact_sum(F.col("Revenue")).alias("Revenue"))
    return sort_bounded(g, F.asc_nulls_last("_idx")).select("Weekday", "Revenue")


def tenure_histogram(customers: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """Customers per bin of months active (``TenureMonths``)."""
    return histogram(customers.select(F.col("MonthsActive").alias("TenureMonths")), "TenureMonths", max_bins)


def order_frequency_histogram(customers: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """Customers per bin of order count."""
    return histogram(customers.select("TotalOrders"), "TotalOrders", max_bins)
