"""Revenue from customers' first order day versus later days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.functions.numeric import exact_sum

# The two row labels.
NEW_LABEL = "New Customer Revenue"
RETURNING_LABEL = "Returning Customer Revenue"


def new_vs_returning(df: DataFrame) -> DataFrame:
    """Two rows (Type, Revenue): lines on a customer's first order day are "new"
    (all orders of that day count), every other line is "returning".

    First-order days are relative to the filtered data.  Lines are reduced to
    (customer, day) totals before anything moves (partial aggregation, so a
    customer with a huge share of lines is pre-combined), and the first day is
    found by a window over those rows: one customer's partition holds at most
    one row per calendar day.
    """
    per_day = df.groupBy("CustomerId", "Date").agg(exact_sum(F.col("Revenue")).alias("_rev"))
    first_day = F.min("Date").over(Window.partitionBy("CustomerId"))
    is_new = F.coalesce(F.col("Date") == first_day, F.lit(False))
    flagged = per_day.withColumn("_new", is_new)
    totals = flagged.agg(
        F.coalesce(exact_sum(F.when(F.col("_new"), F.col("_rev"))), F.lit(0.0)).alias(NEW_LABEL),
        F.coalesce(exact_sum(F.when(~F.col("_new"), F.col("_rev"))), F.lit(0.0)).alias(RETURNING_LABEL),
    )
    return totals.unpivot([], [NEW_LABEL, RETURNING_LABEL], "Type", "Revenue")
