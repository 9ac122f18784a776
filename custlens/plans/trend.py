"""A5/U5 monthly revenue and order trend, gap-filled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.dates import month_start
from custlens.functions.numeric import exact_sum
from custlens.operators.ordering import fill_month_gaps
from custlens.plans.common import sort_bounded, unpivot_metrics


def monthly_trend(df: DataFrame) -> DataFrame:
    """Revenue and distinct orders per calendar month, labelled by month start.

    Every month between the first and last month with data appears; empty ones
    carry 0 revenue and 0 orders (:func:`fill_month_gaps`: no join, one pass
    over the month rows; the window over them is one task over at most one
    row per calendar month).
    """
    per_month = (
        df.where(F.col("Date").isNotNull())
        .groupBy(month_start(F.col("Date")).alias("month_ts"))
        .agg(
            exact_sum(F.col("Revenue")).alias("MonthRevenue"),
            F.count_distinct("OrderId").alias("MonthOrders"),
        )
    )
    filled = fill_month_gaps(per_month, [], "month_ts", ["MonthRevenue", "MonthOrders"])
    return sort_bounded(filled, F.asc("month_ts"))


def monthly_trend_long(df: DataFrame) -> DataFrame:
    """The trend as (month_ts, Metric, Value) rows for plotting."""
    return unpivot_metrics(monthly_trend(df), ["month_ts"], ["MonthRevenue", "MonthOrders"])
