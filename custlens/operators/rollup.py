"""The order-level rollup: the fact reduced to what order-grained reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.numeric import exact_sum

ATTRIBUTES = ["CustomerName", "RegionName", "Address", "City", "Province", "PostalCode"]
ROLLUP_KEYS = ["CustomerId", "OrderId", "Date", "ShippingMethodName", *ATTRIBUTES]


def order_rollup(report_input: DataFrame) -> DataFrame:
    """One row per order (and attribute row of its customer), sums of its lines.

    Every report filter (date, region, shipping method, customer) and every report
    grained by order, day or customer works on these rows as on the lines.  Sums are
    exact, so rollups of parts of the fact add up to the rollup of the whole, and a
    month of orders can be replaced without the others.  Keys are hashed strings and all
    buffers have a fixed width: hash aggregation, partial before its shuffle.
    """
    return report_input.groupBy(*ROLLUP_KEYS).agg(
        exact_sum(F.col("Revenue")).alias("Revenue"),
        exact_sum(F.col("Cost")).alias("Cost"),
        exact_sum(F.col("WeightLb")).alias("WeightLb"),
        F.max("ShipDate").alias("ShipDate"),
        F.count(F.lit(1)).alias("Lines"),
    )


def attribute_rows(rows: DataFrame) -> DataFrame:
    """The distinct (customer, attributes) rows: about one per customer."""
    return rows.select("CustomerId", *ATTRIBUTES).distinct()
