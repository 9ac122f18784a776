"""Adapter from the supplied TPC-H-like test tables to the nine source tables.

The test data has no wholesale order database, so each source table is derived
from the supplied ones by a fixed rule (documented in FIXTURES.md §3).  The same
rules are kept as portable SQL text in :data:`ADAPTER_SQL` for the DuckDB oracle.
Everything here is lazy; Spark reads only the columns each rule touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.functions.text import CATEGORY_SEPARATOR


# Columns of the supplied tables that the adapter reads.  Declaring them skips
# Parquet schema inference (one Spark job per table) and prunes the rest.
SUPPLIED_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, "
                "l_shipdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SUPPLIED_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ts(col: str):
    return F.col(col).cast("timestamp_ntz")


def _s(col):
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def fixture_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The nine raw source tables (before scan predicates) built from ``sf_dir``."""
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    region = _read(spark, sf_dir, "region")
    part = _read(spark, sf_dir, "part")
    supplier = _read(spark, sf_dir, "supplier")

    odate = _ts("o_orderdate")
    src_orders = orders.select(
        _s("o_orderkey").alias("OrderId"),
        _s("o_custkey").alias("CustomerId"),
        _s(F.col("o_orderkey") % 17).alias("SalesRepId"),
        F.col("o_orderstatus").alias("OrderStatus"),
        (odate + F.expr("INTERVAL '9' HOUR")).alias("CreatedAt_order"),
        odate.alias("DateOrdered"),
        (odate + F.expr("INTERVAL '30' DAY")).alias("DateExpected"),
        (odate + F.expr("INTERVAL '37' HOUR")).alias("ShipDate"),
        F.substring("o_orderpriority", 1, 1).alias("ShippingMethodRequested"),
    )

    line_key = F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"))
    src_order_lines = (
        lineitem.groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.max("l_partkey").alias("pk"),
            F.max("l_suppkey").alias("sk"),
            F.sum("l_quantity").alias("QuantityShipped"),
            F.max(F.floor(F.col("l_extendedprice") / 100)).alias("sp"),
            F.max(F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) / 125)).alias("uc"),
            F.max(_ts("l_shipdate")).alias("DateShipped"),
        )
        .select(
            line_key.alias("OrderLineId"),
            _s("l_orderkey").alias("OrderId"),
            _s("pk").alias("ProductId"),
            _s("sk").alias("ShipperId"),
            "QuantityShipped",
            F.col("sp").cast("double").alias("SalePrice"),
            F.col("uc").cast("double").alias("UnitCost"),
            "DateShipped",
            F.col("DateShipped").alias("CreatedAt"),
        )
    )

    key = _s("c_custkey")
    src_customers = customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("CustomerId"),
        F.col("c_name").alias("CustomerName"),
        _s("n_regionkey").alias("RegionId"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "True").otherwise("False").alias("IsRetail"),
        F.concat(F.lit("  "), key, F.lit(" "), F.col("c_mktsegment"), F.lit(" ")).alias("Address1"),
        F.lit("").alias("Address2"),
        F.col("n_name").alias("City"),
        F.col("c_mktsegment").alias("Province"),
        _s(F.col("c_custkey") % 97).alias("PostalCode"),
        F.concat(F.lit("555-"), key).alias("Phone"),
        F.concat(F.lit("c"), key, F.lit("@example.com")).alias("Email"),
    )

    pkey = _s("p_partkey")
    src_products = part.select(
        pkey.alias("ProductId"),
        F.when(F.col("p_type").isin("ECONOMY", "SMALL", "LARGE"), "3").otherwise("1").alias("UnitOfBillingId"),
        _s(F.col("p_partkey") % 12).alias("SupplierId"),
        F.concat(F.lit("SKU"), pkey).alias("SKU"),
        F.when(F.col("p_size") % 7 == 0, F.col("p_name"))
        .otherwise(F.concat(F.col("p_brand"), F.lit(CATEGORY_SEPARATOR), F.col("p_name")))
        .alias("ProductName"),
        _s(F.floor("p_retailprice").cast("bigint")).alias("ProductListPrice"),
        _s(F.floor(F.col("p_retailprice") / 2).cast("bigint")).alias("CostPrice"),
    )

    src_regions = region.select(
        _s("r_regionkey").alias("RegionId"), F.col("r_name").alias("RegionName")
    )
    src_shippers = supplier.select(_s("s_suppkey").alias("ShipperId"), F.col("s_name").alias("Carrier"))
    src_shipping_methods = orders.select(
        F.substring("o_orderpriority", 1, 1).alias("SMId"),
        F.expr("substr(o_orderpriority, 3)").alias("ShippingMethodName"),
    ).distinct()
    src_suppliers = supplier.select(
        _s("s_suppkey").alias("SupplierId"), F.col("s_name").alias("SupplierName")
    )
    src_packs = lineitem.select(
        line_key.alias("PickedForOrderLine"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .otherwise(F.col("l_quantity"))
        .alias("WeightLb"),
        (F.floor(F.col("l_quantity") / 10) + 1).cast("double").alias("ItemCount"),
        _ts("l_shipdate").alias("DeliveryDate"),
    )

    return {
        "orders": src_orders,
        "order_lines": src_order_lines,
        "customers": src_customers,
        "products": src_products,
        "regions": src_regions,
        "shippers": src_shippers,
        "shipping_methods": src_shipping_methods,
        "suppliers": src_suppliers,
        "packs": src_packs,
    }


# The same adapter as portable SQL (Spark SQL and DuckDB), one CTE per table.
ADAPTER_SQL = {
    "src_orders": """
SELECT CAST(o_orderkey AS STRING) AS OrderId, CAST(o_custkey AS STRING) AS CustomerId,
       CAST(o_orderkey % 17 AS STRING) AS SalesRepId, o_orderstatus AS OrderStatus,
       o_orderdate + INTERVAL '9' HOUR AS CreatedAt_order, o_orderdate AS DateOrdered,
       o_orderdate + INTERVAL '30' DAY AS DateExpected,
       o_orderdate + INTERVAL '37' HOUR AS ShipDate,
       substr(o_orderpriority, 1, 1) AS ShippingMethodRequested
FROM orders""",
    "src_order_lines": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS OrderLineId,
       CAST(l_orderkey AS STRING) AS OrderId, CAST(max(l_partkey) AS STRING) AS ProductId,
       CAST(max(l_suppkey) AS STRING) AS ShipperId, sum(l_quantity) AS QuantityShipped,
       CAST(max(floor(l_extendedprice / 100)) AS DOUBLE) AS SalePrice,
       CAST(max(floor(l_extendedprice * (1 - l_discount) / 125)) AS DOUBLE) AS UnitCost,
       max(l_shipdate) AS DateShipped, max(l_shipdate) AS CreatedAt
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "src_customers": """
SELECT CAST(c_custkey AS STRING) AS CustomerId, c_name AS CustomerName, CAST(n_regionkey AS STRING) AS RegionId,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'True' ELSE 'False' END AS IsRetail,
       '  ' || CAST(c_custkey AS STRING) || ' ' || c_mktsegment || ' ' AS Address1, '' AS Address2,
       n_name AS City, c_mktsegment AS Province, CAST(c_custkey % 97 AS STRING) AS PostalCode,
       '555-' || CAST(c_custkey AS STRING) AS Phone, 'c' || CAST(c_custkey AS STRING) || '@example.com' AS Email
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "src_products": """
SELECT CAST(p_partkey AS STRING) AS ProductId,
       CASE WHEN p_type IN ('ECONOMY', 'SMALL', 'LARGE') THEN '3' ELSE '1' END AS UnitOfBillingId,
       CAST(p_partkey % 12 AS STRING) AS SupplierId, 'SKU' || CAST(p_partkey AS STRING) AS SKU,
       CASE WHEN p_size % 7 = 0 THEN p_name ELSE p_brand || ' – ' || p_name END AS ProductName,
       CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) AS ProductListPrice,
       CAST(CAST(floor(p_retailprice / 2) AS BIGINT) AS STRING) AS CostPrice
FROM part""",
    "src_regions": """
SELECT CAST(r_regionkey AS STRING) AS RegionId, r_name AS RegionName FROM region""",
    "src_shippers": """
SELECT CAST(s_suppkey AS STRING) AS ShipperId, s_name AS Carrier FROM supplier""",
    "src_shipping_methods": """
SELECT DISTINCT substr(o_orderpriority, 1, 1) AS SMId, substr(o_orderpriority, 3) AS ShippingMethodName FROM orders""",
    "src_suppliers": """
SELECT CAST(s_suppkey AS STRING) AS SupplierId, s_name AS SupplierName FROM supplier""",
    "src_packs": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS PickedForOrderLine,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS WeightLb,
       CAST(floor(l_quantity / 10) + 1 AS DOUBLE) AS ItemCount, l_shipdate AS DeliveryDate
FROM lineitem""",
}
