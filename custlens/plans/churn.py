"""Churn by region, monthly churn trend, churned details."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions.dates import month_end, month_start
from custlens.operators.ordering import month_spine
from custlens.plans.common import sort_bounded


def churned(customers: DataFrame, threshold: int) -> DataFrame:
    """customers with DaysSinceLastOrder strictly above ``threshold``."""
    return customers.where(F.col("DaysSinceLastOrder") > threshold)


def churn_by_region(customers: DataFrame, threshold: int = 90) -> DataFrame:
    """Churned customers per region (null region kept as its own row)."""
    return churned(customers, threshold).groupBy("RegionName").agg(
        F.count("CustomerId").alias("ChurnCount")  # ids are unique in the customer table
    ).transform(lambda d: sort_bounded(d, F.desc("ChurnCount"), F.asc_nulls_last("RegionName")))


def monthly_churn_trend(customers: DataFrame, churn_days: int = 90) -> DataFrame:
    """For every month from the first to the last order month, the number of
    customers whose last order is more than ``churn_days`` before the month's end.

    A customer with last order L counts from the month containing
    L + churn_days + 1 onwards (L < month_end - churn_days  <=>
    L + churn_days + 1 <= month_end).  So each customer is counted once in that
    month and a running sum over months gives the trend: O(customers), with no
    months x customers pairing.  The running sum is a single-task window over
    month rows only, bounded by the calendar span.  ``Month`` is the month's
    last day.
    """
    # The first and last order of all customers bound the order dates.
    bounds = customers.agg(
        month_start(F.min("FirstOrder")).alias("_s"), month_start(F.max("LastOrder")).alias("_e")
    ).where(F.col("_s").isNotNull())
    spine = month_spine(bounds, "_s", "_e", "_m").select(
        "_m", F.lit(0).cast("bigint").alias("_c"), F.lit(True).alias("_spine")
    )
    first_month = month_start(F.date_add(F.col("LastOrder"), churn_days + 1))
    counts = (
        customers.where(F.col("CustomerId").isNotNull() & F.col("LastOrder").isNotNull())
        .groupBy(first_month.alias("_m"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_spine", F.lit(False))
    )
    running = Window.orderBy("_m", "_spine").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.unionByName(spine)
        .withColumn("ChurnedCustomers", F.sum("_c").over(running))
        .where(F.col("_spine"))
        .select(month_end(F.col("_m")).alias("Month"), F.col("ChurnedCustomers").cast("bigint"))
    )


def churned_customer_details(customers: DataFrame, threshold: int = 90) -> DataFrame:
    """One export row per churned customer with revenue, cost and profit
    (a missing amount counts as 0 in the profit)."""
    amount = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return churned(customers, threshold).select(
        "CustomerId", "CustomerName", "RegionName", "LastOrder", "DaysSinceLastOrder", "TotalRevenue", "TotalCost",
        (amount("TotalRevenue") - amount("TotalCost")).alias("GrossProfit"), "Address", "City", "Province", "PostalCode",
    )
