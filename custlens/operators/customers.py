"""A2 + P16-P19 + J11: one row per customer, via one row per customer order."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.numeric import clip_lower, exact_sum, rint2, safe_divide
from custlens.operators.rollup import ATTRIBUTES, attribute_rows
from custlens.schemas import CUSTOMER_AGG


def order_level(df: DataFrame) -> DataFrame:
    """Lines, or the rollup of lines, reduced to one row per (CustomerId, OrderId),
    numeric measures only.

    Hash aggregation, partial before its shuffle, so a customer or order
    holding a large share of all lines is pre-combined in every map task.
    """
    return df.groupBy("CustomerId", "OrderId").agg(
        exact_sum(F.col("Revenue")).alias("Revenue"),
        exact_sum(F.col("Cost")).alias("Cost"),
        exact_sum(F.col("WeightLb")).alias("WeightLb"),
        F.min("Date").alias("FirstDate"),
        F.max("Date").alias("LastDate"),
        F.max("ShipDate").alias("LastShip"),
    )


def _customer_key() -> dict:
    """Join key for the null-aware customer match: the id with nulls as '' plus
    a null flag.  Both parts are plain equalities, so the optimizer can drop
    the attribute join when no attribute is used (a null-safe ``<=>`` join
    blocks that)."""
    return {"__ck": F.coalesce(F.col("CustomerId"), F.lit("")), "__ck_null": F.col("CustomerId").isNull()}


def customer_attributes(rows: DataFrame) -> DataFrame:
    """One row per customer key from its distinct attribute rows (:func:`attribute_rows`).

    Attributes come from the customer lookup and depend only on the customer; where
    one id has several attribute rows, the least whole row is taken, so a name and a
    city never come from different rows.  A minimum over strings cannot use the hash
    aggregate (variable-width buffer) and would sort every line, so it is taken over
    rows that are customer-scale already.
    """
    combos = rows.withColumns(_customer_key()).select("__ck", "__ck_null", *ATTRIBUTES)
    # min_by(x, x) is min(x).  Written this way because Catalyst drops a
    # distinct below duplicate-insensitive aggregates such as min, which would
    # put the string aggregation back over every line.
    whole = F.struct(*ATTRIBUTES)
    return combos.groupBy("__ck", "__ck_null").agg(F.min_by(whole, whole).alias("a")).select(
        "__ck", "__ck_null", *[F.col(f"a.{c}").alias(c) for c in ATTRIBUTES])


def customer_aggregates(
    df: DataFrame, as_of: dt.date, orders: DataFrame | None = None, attributes: DataFrame | None = None
) -> DataFrame:
    """Per-customer totals, first/last order and activity measures.

    * Grouped by ``CustomerId``; a null id forms its own group.
    * Measures: lines -> (customer, order) -> customer, two hash aggregations
      with partial aggregation before each shuffle; ``TotalOrders`` counts the
      customer's non-null order ids (one row per pair), so no distinct aggregate.
    * Attributes: :func:`customer_attributes` of the rows given in ``attributes`` (the
      customer lookup, or the stored attribute table), so ``df`` is read once; without
      them, of the distinct attribute rows of ``df``, a second pass.  They are attached by
      a left join at customer scale that Catalyst removes when a report uses none.
    * ``DeliveryTime`` is the latest ship date; null for the null-id group.
    * ``as_of`` replaces the clock; both date measures are whole days.
    """
    orders = order_level(df) if orders is None else orders
    measures = orders.groupBy("CustomerId").agg(
        exact_sum(F.col("Revenue")).alias("TotalRevenue"),
        exact_sum(F.col("Cost")).alias("TotalCost"),
        F.count("OrderId").alias("TotalOrders"),
        exact_sum(F.col("WeightLb")).alias("TotalWeight"),
        F.min("FirstDate").alias("FirstOrder"),
        F.max("LastDate").alias("LastOrder"),
        F.when(F.col("CustomerId").isNotNull(), F.max("LastShip")).alias("DeliveryTime"),
    ).withColumns(_customer_key())
    named = customer_attributes(attribute_rows(df) if attributes is None else attributes)
    agg = measures.join(named, ["__ck", "__ck_null"], "left").drop("__ck", "__ck_null").withColumn(
        "Address", F.coalesce("Address", F.lit("")))  # as the report input has it without a lookup row
    as_of_lit = F.lit(as_of)
    months_active = clip_lower(F.floor(F.datediff(as_of_lit, F.col("FirstOrder")) / 30), 1)
    out = agg.withColumns({
        "TotalOrders": F.col("TotalOrders").cast("bigint"),
        "AvgOrderWt": rint2(F.coalesce(safe_divide(F.col("TotalWeight"), F.col("TotalOrders")), F.lit(0.0))),
        "DaysSinceLastOrder": clip_lower(F.datediff(as_of_lit, F.col("LastOrder")), 0).cast("bigint"),
        "MonthsActive": months_active.cast("bigint"),
    }).withColumn(
        "RepeatRate", rint2(F.col("TotalOrders") / F.col("MonthsActive"))
    )
    return out.select(CUSTOMER_AGG.fieldNames())
