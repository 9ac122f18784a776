"""Top customers per region and new-customer recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.config import ensure_checkpoint_dir
from custlens.functions.numeric import exact_sum
from custlens.plans.common import sort_bounded

_KEYS = ["RegionName", "CustomerName"]


def _top_n(totals: DataFrame, n: int) -> DataFrame:
    """``row_number <= n`` per region: planned with a partial WindowGroupLimit
    before the shuffle, so a region holding a large share of customers sends
    at most n rows per map task."""
    w = Window.partitionBy("RegionName").orderBy(
        F.desc_nulls_last("TotalRevenue"), F.asc_nulls_last("CustomerName")
    )
    return totals.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def _sorted_top(top: DataFrame) -> DataFrame:
    """T5: regions ascending (nulls last), revenue rank within the region."""
    return sort_bounded(top, F.asc_nulls_last("RegionName"), F.asc("_rn")).select(
        "RegionName", "CustomerName", "TotalRevenue"
    )


def top_customers_per_region(df: DataFrame, n: int = 50) -> DataFrame:
    """The n highest-revenue (RegionName, CustomerName) groups per region.

    Grouping is by *name*, not id.  Null regions and names are groups of their
    own.  Ties keep names in ascending order (nulls last).
    """
    totals = df.groupBy(*_KEYS).agg(exact_sum(F.col("Revenue")).alias("TotalRevenue"))
    return _sorted_top(_top_n(totals, n))


def compute_recommendations(
    df: DataFrame, top_n: int = 50, min_lineitem_revenue: float = 500.0
) -> dict[str, DataFrame]:
    """``{"top": top-N per region, "recommended": new customers}``.

    One (region, customer) aggregation of the lines feeds both results: the
    total revenue ranks the top-N, and conditional aggregates over the lines
    above the threshold give the recommendation totals.  The totals (one row per
    customer and region) are stored once, so the lines are scanned once for both.

    Recommendations (R5): per region, customers outside its top-N with at
    least one line strictly above the threshold; totals cover only those
    lines.  Lines without a region are never recommended.  The exclusion
    matches names null-safely.  The anti-join runs at (region, customer)
    grain against at most N rows per region; AQE turns it into a broadcast
    join from the exact runtime size of the top-N, with no extra job.
    """
    qualifies = F.col("Revenue") > F.lit(float(min_lineitem_revenue))
    totals = df.groupBy(*_KEYS).agg(
        exact_sum(F.col("Revenue")).alias("TotalRevenue"),
        exact_sum(F.when(qualifies, F.col("Revenue"))).alias("_q_revenue"),
        F.count_distinct(F.when(qualifies, F.col("OrderId"))).alias("_q_orders"),
        exact_sum(F.when(qualifies, F.col("ItemCount"))).alias("_q_items"),
        F.count_if(qualifies).alias("_q_lines"),
    )
    ensure_checkpoint_dir(df.sparkSession)
    totals = totals.checkpoint(eager=True)
    top = _top_n(totals, top_n)
    candidates = totals.where(F.col("RegionName").isNotNull() & (F.col("_q_lines") > 0)).select(
        "RegionName", "CustomerName",
        F.col("_q_revenue").alias("TotalRevenue"),
        F.col("_q_orders").cast("bigint").alias("OrderFrequency"),
        F.col("_q_items").alias("TotalQuantity"),
    )
    exclude = top.select(F.col("RegionName").alias("_r"), F.col("CustomerName").alias("_c"))
    cond = (candidates["RegionName"] == exclude["_r"]) & candidates["CustomerName"].eqNullSafe(exclude["_c"])
    recommended = candidates.join(exclude, cond, "left_anti").orderBy(
        F.asc("RegionName"), F.desc_nulls_last("TotalRevenue"), F.desc_nulls_last("OrderFrequency"),
        F.asc_nulls_last("CustomerName"),
    )
    return {"top": _sorted_top(top), "recommended": recommended}


def recommend_customers(df: DataFrame, top_n: int = 50, min_lineitem_revenue: float = 500.0) -> DataFrame:
    """The recommendation table of :func:`compute_recommendations`."""
    return compute_recommendations(df, top_n, min_lineitem_revenue)["recommended"]
