"""Cohort retention by month of first order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.dates import month_start
from custlens.functions.numeric import rint2, safe_divide
from custlens.plans.common import sort_bounded


def cohort_retention(customers: DataFrame, active_days: int = 90) -> DataFrame:
    """Customers per first-order month and how many ordered within ``active_days``.

    Months without new customers are not filled in.  ``TotalCustomers`` counts
    non-null ids; ``RetentionRate`` is rounded to 2 decimals (null when a cohort
    has no counted customer).
    """
    g = customers.groupBy(month_start(F.col("FirstOrder")).alias("CohortMonth")).agg(
        F.count("CustomerId").alias("TotalCustomers"),
        F.count_if(F.col("DaysSinceLastOrder") <= active_days).alias("StillActive90"),
    )
    return g.withColumn(
        "RetentionRate", rint2(safe_divide(F.col("StillActive90"), F.col("TotalCustomers")))
    ).transform(lambda d: sort_bounded(d, F.asc_nulls_last("CohortMonth")))
