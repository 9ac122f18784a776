"""Customer drilldown, computed for all customers at once.

The original shows one selected customer.  Here every report is keyed by
customer, so one distributed job serves any selection; an optional
``customer_id``/``name`` filter is pushed down by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custlens.config import ensure_checkpoint_dir
from custlens.functions.dates import month_end, month_start
from custlens.functions.numeric import exact_sum
from custlens.functions.text import product_category
from custlens.operators.ordering import fill_month_gaps
from custlens.plans.common import unpivot_metrics


def customer_profile(customers: DataFrame, name: str | None = None) -> DataFrame:
    """Profile of the customer a name resolves to.

    A name resolves to its highest-revenue customer (ties: smallest id).
    ``row_number() = 1`` per name is planned with a partial group limit, so a
    name shared by very many customers is cut down before the shuffle.
    """
    named = customers.where(F.col("CustomerName").isNotNull())
    if name is not None:
        named = named.where(F.col("CustomerName") == name)
    w = Window.partitionBy("CustomerName").orderBy(
        F.desc_nulls_last("TotalRevenue"), F.asc_nulls_last("CustomerId")
    )
    return named.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).select(
        "CustomerName", "CustomerId", "RegionName", "FirstOrder", "LastOrder",
        F.col("DeliveryTime").alias("LastDelivery"), "TotalRevenue", "TotalOrders",
        "AvgOrderWt", "RepeatRate",
    )


def _with_id(df: DataFrame, customer_id: str | None) -> DataFrame:
    df = df.where(F.col("CustomerId").isNotNull())
    return df if customer_id is None else df.where(F.col("CustomerId") == customer_id)


def customer_monthly_history(df: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Per customer and month, revenue and distinct orders, labelled by
    month *end*, gap-filled between that customer's own first and last month.

    Gap filling is :func:`fill_month_gaps`: one shuffle by customer for the
    bounds window, after which the final sum needs no further exchange; rows
    per customer are bounded by the calendar span.
    """
    d = _with_id(df, customer_id).where(F.col("Date").isNotNull())
    per_month = d.groupBy("CustomerId", month_start(F.col("Date")).alias("_m")).agg(
        exact_sum(F.col("Revenue")).alias("MonthlyRevenue"),
        F.count_distinct("OrderId").alias("MonthlyOrders"),
    )
    filled = fill_month_gaps(per_month, ["CustomerId"], "_m", ["MonthlyRevenue", "MonthlyOrders"])
    return filled.select(
        "CustomerId", month_end(F.col("_m")).alias("month_ts"), "MonthlyRevenue", "MonthlyOrders"
    )


def customer_monthly_history_long(df: DataFrame, customer_id: str | None = None) -> DataFrame:
    return unpivot_metrics(
        customer_monthly_history(df, customer_id), ["CustomerId", "month_ts"],
        ["MonthlyRevenue", "MonthlyOrders"],
    )


def product_category_mix(df: DataFrame, customer_id: str | None = None) -> DataFrame:
    """Spend and weight per product category and customer.

    The category is the product name up to the first " – " separator (null
    names stay null).  Rows per customer are bounded by the category count.
    """
    return _with_id(df, customer_id).groupBy(
        "CustomerId", product_category(F.col("ProductName")).alias("ProductCategory")
    ).agg(exact_sum(F.col("Revenue")).alias("Spend"), exact_sum(F.col("WeightLb")).alias("Weight")).orderBy(
        "CustomerId", F.desc("Spend"), F.asc_nulls_last("ProductCategory")
    )


def customer_drilldown(df: DataFrame, customers: DataFrame, names: list[str]) -> dict[str, DataFrame]:
    """names -> customer ids -> profile, monthly history and category mix.

    The profiles (at most one per name) are stored and their ids become literals of the
    line filter, which reaches the scan: in a stored fact, whose files are sorted by
    customer and carry Bloom filters of the ids, other customers' row groups are skipped.
    """
    wanted = customers.where(F.col("CustomerName").isin(list(names)))
    ensure_checkpoint_dir(df.sparkSession)
    profile = customer_profile(wanted).checkpoint(eager=True)
    ids = [r["CustomerId"] for r in profile.select("CustomerId").collect() if r["CustomerId"] is not None]
    lines = df.where(F.col("CustomerId").isin(ids))
    return {
        "profile": profile,
        "monthly_history": customer_monthly_history(lines).orderBy("CustomerId", "month_ts"),
        "category_mix": product_category_mix(lines),
    }
