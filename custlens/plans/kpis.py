"""R1/A3/A4 customer KPIs and T2 top-10 by revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.numeric import exact_sum, safe_divide
from custlens.plans.common import top_k


def customer_kpis(orders: DataFrame, customers: DataFrame, churn_days: int = 90) -> DataFrame:
    """One row: TotalCustomers, TotalRevenue, TotalOrders, AvgOrderValue, ChurnRatePct.

    ``orders`` is the (customer, order) level that the customer table is made of
    (:func:`order_level`), or the lines themselves; it is reduced to one row per order.
    Order rows and customer rows are then unioned and folded by one global aggregate,
    so no join (and no cross join) is needed.
    * AvgOrderValue: mean of per-order revenue (null order id excluded), 0 if no orders.
    * ChurnRatePct: share of customer rows with DaysSinceLastOrder > churn_days,
      over the distinct non-null customer ids; 0 if there are none.
    """
    per_order = orders.groupBy("OrderId").agg(exact_sum(F.col("Revenue")).alias("_rev"))
    order_rows = per_order.select(
        "OrderId", "_rev",
        F.lit(None).cast("string").alias("CustomerId"),
        F.lit(None).cast("bigint").alias("_days"),
        F.lit(False).alias("_is_customer"),
    )
    customer_rows = customers.select(
        F.lit(None).cast("string").alias("OrderId"),
        F.lit(None).cast("double").alias("_rev"),
        "CustomerId",
        F.col("DaysSinceLastOrder").alias("_days"),
        F.lit(True).alias("_is_customer"),
    )
    total_customers = F.count("CustomerId")
    churned = F.count_if(F.col("_is_customer") & (F.col("_days") > churn_days))
    return order_rows.unionByName(customer_rows).agg(
        total_customers.alias("TotalCustomers"),
        F.coalesce(exact_sum(F.col("_rev")), F.lit(0.0)).alias("TotalRevenue"),
        F.count("OrderId").alias("TotalOrders"),
        F.coalesce(safe_divide(exact_sum(F.when(F.col("OrderId").isNotNull(), F.col("_rev"))), F.count("OrderId")), F.lit(0.0)).alias("AvgOrderValue"),
        F.when(total_customers > 0, churned * 100.0 / total_customers).otherwise(F.lit(0.0)).alias("ChurnRatePct"),
    )


def top10_revenue(customers: DataFrame, k: int = 10) -> DataFrame:
    """The k customers with the highest revenue (ties: CustomerId ascending)."""
    ranked = top_k(customers, [F.desc_nulls_last("TotalRevenue"), F.asc_nulls_last("CustomerId")], k)
    return ranked.select(
        "CustomerName",
        "RegionName",
        F.col("TotalRevenue").alias("Revenue"),
        F.col("TotalOrders").alias("Orders"),
        F.col("RepeatRate").alias("RetentionRate"),
    )
