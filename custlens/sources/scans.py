"""Scans of the nine source tables.

Raw tables can come from Parquet, from a JDBC database, or from the fixture
adapter.  :func:`scan_sources` then applies the source predicates and column
aliasing declaratively, so Catalyst pushes them into the Parquet reader
(``PushedFilters``/``ReadSchema``) or into the SQL sent over JDBC.
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.config import Params
from custlens.functions.dates import to_timestamp_tolerant
from custlens.functions.text import normalize_key
from custlens.schemas import FACT_KEYS, FACT_SOURCES, SCAN_COLUMNS, SOURCE_SCHEMAS

log = logging.getLogger(__name__)

# Table and column names of the operational SQL Server database.
# Maps source-table name -> (database table, {database column: source column}).
DB_TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "orders": ("dbo.Orders", {
        "OrderId": "OrderId", "CustomerId": "CustomerId", "SalesRepId": "SalesRepId",
        "OrderStatus": "OrderStatus", "CreatedAt": "CreatedAt_order", "DateOrdered": "DateOrdered",
        "DateExpected": "DateExpected", "DateShipped": "ShipDate",
        "ShippingMethodRequested": "ShippingMethodRequested"}),
    "order_lines": ("dbo.OrderLines", {
        "OrderLineId": "OrderLineId", "OrderId": "OrderId", "ProductId": "ProductId",
        "ShipperId": "ShipperId", "QuantityShipped": "QuantityShipped", "Price": "SalePrice",
        "CostPrice": "UnitCost", "DateShipped": "DateShipped", "CreatedAt": "CreatedAt"}),
    "customers": ("dbo.Customers", {
        "CustomerId": "CustomerId", "Name": "CustomerName", "RegionId": "RegionId",
        "IsRetail": "IsRetail", "Address1": "Address1", "Address2": "Address2", "City": "City",
        "Province": "Province", "PostalCode": "PostalCode", "Phone": "Phone", "Email": "Email"}),
    "products": ("dbo.Products", {
        "ProductId": "ProductId", "UnitOfBillingId": "UnitOfBillingId", "SupplierId": "SupplierId",
        "SKU": "SKU", "Description": "ProductName", "ListPrice": "ProductListPrice",
        "CostPrice": "CostPrice"}),
    "regions": ("dbo.Regions", {"RegionId": "RegionId", "Name": "RegionName"}),
    "shippers": ("dbo.Shippers", {"ShipperId": "ShipperId", "Name": "Carrier"}),
    "shipping_methods": ("dbo.ShippingMethods", {"ShippingMethodId": "SMId", "Name": "ShippingMethodName"}),
    "suppliers": ("dbo.Suppliers", {"SupplierId": "SupplierId", "Name": "SupplierName"}),
    "packs": ("dbo.Packs", {
        "PickedForOrderLine": "PickedForOrderLine", "WeightLb": "WeightLb",
        "ItemCount": "ItemCount", "ShippedAt": "DeliveryDate"}),
}


def conform_source(df: DataFrame, name: str) -> DataFrame:
    """A stored table in the columns of its source schema, with its own key types.

    Key columns of the fact's sources must exist; any other absent column is added as
    nulls.  Keys and numbers keep their stored type (the fact normalises keys of any
    type and parses numbers tolerantly); times become zone-less timestamps, and text
    that is no time becomes null.
    """
    missing = [c for c in FACT_KEYS.get(name, ()) if c not in df.columns]
    if missing:
        raise KeyError(f"source table '{name}' lacks its key columns {missing}; it has {df.columns}")
    out = []
    for field in SOURCE_SCHEMAS[name].fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.dataType.typeName() == "timestamp_ntz":
            out.append(to_timestamp_tolerant(F.col(field.name), df.schema[field.name].dataType).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(out)


# Tables that grow with the business: read in parallel parts or not at all.
PARTITIONED_TABLES = ("orders", "order_lines", "packs")
PARTITION_OPTIONS = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")


def readable(df: DataFrame, name: str, whole: bool = True) -> bool:
    """Whether a lookup can be read, by trying: the columns that its scan takes, of all
    its rows (``whole``) or of the first one.

    A file that fails only when its pages are read, or a database table without the
    right to select from it, shows here and not in the middle of the fact build.  No row
    leaves its task.
    """
    probe = df.select([c for c in SCAN_COLUMNS[name] if c in df.columns])
    try:
        if whole:
            probe.write.format("noop").mode("overwrite").save()
        else:
            probe.isEmpty()
    except Exception as e:  # whatever its reader raises
        log.warning("lookup '%s' cannot be read: %s", name, type(e).__name__)
        return False
    return True


def parquet_sources(spark: SparkSession, root: str, probe: bool = True) -> dict[str, DataFrame]:
    """Raw tables stored as ``<root>/<name>`` Parquet datasets, on any filesystem.

    Spark resolves each path through its filesystem and reads the stored schema.  A
    lookup that is absent or cannot be read is left out (:func:`scan_sources` joins it
    as empty); orders and order lines must be readable and hold their keys.  ``probe``
    reads the lookups once to find those that fail only then (not the packs, which grow
    with the business: a failure there fails the build).
    """
    raw = {}
    for name in SOURCE_SCHEMAS:
        try:
            df = conform_source(spark.read.parquet(f"{root.rstrip('/')}/{name}"), name)
        except Exception as e:  # no such folder, no schema, or a footer that can't be read
            if name in FACT_SOURCES:
                raise
            log.warning("lookup '%s' cannot be read: %s", name, type(e).__name__)
            continue
        if not probe or name in PARTITIONED_TABLES or readable(df, name):
            raw[name] = df
    return raw


def jdbc_sources(
    spark: SparkSession,
    url: str,
    properties: dict[str, str] | None = None,
    partitioning: dict[str, dict[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """Raw tables read over JDBC, renamed to the source column names.

    Filters and projections applied later are pushed into the generated SQL.
    ``partitioning`` gives per-table parallel-read options (``partitionColumn``,
    ``lowerBound``, ``upperBound``, ``numPartitions``).  Orders, order lines and packs
    must have them: an unpartitioned read would pull a whole table through one task.
    A lookup that the database refuses is left out, as in :func:`parquet_sources`.
    """
    for name in PARTITIONED_TABLES:
        lacking = [o for o in PARTITION_OPTIONS if o not in (partitioning or {}).get(name, {})]
        if lacking:
            raise ValueError(f"reading '{name}' over JDBC needs the options {lacking}")
    raw = {}
    for name, (table, columns) in DB_TABLES.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        reader = reader.option("preferTimestampNTZ", "true")
        for key, value in (properties or {}).items():
            reader = reader.option(key, value)
        for key, value in (partitioning or {}).get(name, {}).items():
            reader = reader.option(key, value)
        try:
            df = reader.load()
            df = df.select([F.col(db).alias(src) for db, src in columns.items()])
        except Exception as e:  # no such table or column, no right to read it
            if name in FACT_SOURCES:
                raise
            log.warning("lookup '%s' cannot be read: %s", name, type(e).__name__)
            continue
        if name in PARTITIONED_TABLES or readable(df, name, whole=False):
            raw[name] = df
    return raw


def _midnight(day: dt.date):
    """A date bound compared like a SQL ``BETWEEN`` on a date string: midnight."""
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def _empty(spark: SparkSession, name: str) -> DataFrame:
    schema = SOURCE_SCHEMAS[name]
    return spark.createDataFrame([], schema).select(SCAN_COLUMNS[name])


def scan_orders(orders: DataFrame, params: Params) -> DataFrame:
    """Packed orders created in the fetch range (inclusive midnight bounds)."""
    return orders.where(
        (F.col("OrderStatus") == params.packed_status)
        & F.col("CreatedAt_order").between(_midnight(params.fetch_start), _midnight(params.fetch_end))
    ).select(SCAN_COLUMNS["orders"])


def scan_order_lines(lines: DataFrame, params: Params) -> DataFrame:
    """Order lines by their own creation time, independent of the order's."""
    return lines.where(
        F.col("CreatedAt").between(_midnight(params.fetch_start), _midnight(params.fetch_end))
    ).select(SCAN_COLUMNS["order_lines"])


def with_line_key(packs: DataFrame) -> DataFrame:
    """Packs with their normalised order-line key as ``OrderLineId``."""
    return packs.withColumn(
        "OrderLineId", normalize_key(F.col("PickedForOrderLine"), packs.schema["PickedForOrderLine"].dataType))


def scan_packs(packs: DataFrame, lines_raw: DataFrame, params: Params) -> DataFrame:
    """Packs of order lines created in the fetch range (semi-join).

    Keys are compared after normalisation (stripped strings), the same rule the
    fact build uses to attach packs to lines, so both paths keep the same packs.
    The key stays as a column: the packs leave the join partitioned by it, and the
    sums per line that follow need no further exchange.
    """
    lines = scan_order_lines(lines_raw, params)
    in_range = lines.select(
        normalize_key(F.col("OrderLineId"), lines.schema["OrderLineId"].dataType).alias("OrderLineId"))
    return with_line_key(packs.select(SCAN_COLUMNS["packs"])).join(in_range, "OrderLineId", "left_semi")


def scan_sources(
    spark: SparkSession, raw: dict[str, DataFrame], params: Params, reduce_packs: bool = True
) -> dict[str, DataFrame]:
    """All nine scans.  Missing lookups become empty typed tables.

    ``reduce_packs`` keeps only packs of order lines in the fetch range (S9), which reads
    the lines once more.  The fact build joins the packs to those lines anyway, so it
    leaves the step out and reads the lines once.
    """
    for name in FACT_SOURCES:
        if name not in raw:
            raise KeyError(f"source table '{name}' is required to build the fact")
        missing = [c for c in FACT_KEYS[name] if c not in raw[name].columns]
        if missing:
            raise KeyError(f"source table '{name}' lacks its key columns {missing}")
    scanned = {
        "orders": scan_orders(raw["orders"], params),
        "order_lines": scan_order_lines(raw["order_lines"], params),
    }
    for name in ("customers", "products", "regions", "shippers", "shipping_methods", "suppliers"):
        if name in raw:
            scanned[name] = raw[name].select(SCAN_COLUMNS[name])
        else:
            log.warning("lookup '%s' missing - joined as empty", name)
            scanned[name] = _empty(spark, name)
    if "packs" in raw:
        scanned["packs"] = (
            scan_packs(raw["packs"], raw["order_lines"], params) if reduce_packs
            else with_line_key(raw["packs"].select(SCAN_COLUMNS["packs"]))
        )
    else:
        scanned["packs"] = with_line_key(_empty(spark, "packs"))
    return scanned


def source_row_counts(scanned: dict[str, DataFrame]) -> DataFrame:
    """Rows per scanned source table as one DataFrame (Table, Rows)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("Rows")).select(F.lit(name).alias("Table"), "Rows")
        for name, df in scanned.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
