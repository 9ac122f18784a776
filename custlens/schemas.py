"""Declared schemas: the nine source tables, the fact and the customer aggregate."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

S, D, TS, DATE, L = StringType(), DoubleType(), TimestampNTZType(), DateType(), LongType()


def _struct(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


# Source tables after the column aliasing of the scans.  ``OrderStatus`` and
# ``CreatedAt`` are filter-only columns and are not projected by the scans.
ORDERS = _struct(
    ("OrderId", S), ("CustomerId", S), ("SalesRepId", S), ("OrderStatus", S),
    ("CreatedAt_order", TS), ("DateOrdered", TS), ("DateExpected", TS),
    ("ShipDate", TS), ("ShippingMethodRequested", S),
)
ORDER_LINES = _struct(
    ("OrderLineId", S), ("OrderId", S), ("ProductId", S), ("ShipperId", S),
    ("QuantityShipped", D), ("SalePrice", D), ("UnitCost", D),
    ("DateShipped", TS), ("CreatedAt", TS),
)
CUSTOMERS = _struct(
    ("CustomerId", S), ("CustomerName", S), ("RegionId", S), ("IsRetail", S),
    ("Address1", S), ("Address2", S), ("City", S), ("Province", S),
    ("PostalCode", S), ("Phone", S), ("Email", S),
)
PRODUCTS = _struct(
    ("ProductId", S), ("UnitOfBillingId", S), ("SupplierId", S), ("SKU", S),
    ("ProductName", S), ("ProductListPrice", S), ("CostPrice", S),
)
REGIONS = _struct(("RegionId", S), ("RegionName", S))
SHIPPERS = _struct(("ShipperId", S), ("Carrier", S))
SHIPPING_METHODS = _struct(("SMId", S), ("ShippingMethodName", S))
SUPPLIERS = _struct(("SupplierId", S), ("SupplierName", S))
PACKS = _struct(
    ("PickedForOrderLine", S), ("WeightLb", D), ("ItemCount", D), ("DeliveryDate", TS),
)

SOURCE_SCHEMAS: dict[str, StructType] = {
    "orders": ORDERS,
    "order_lines": ORDER_LINES,
    "customers": CUSTOMERS,
    "products": PRODUCTS,
    "regions": REGIONS,
    "shippers": SHIPPERS,
    "shipping_methods": SHIPPING_METHODS,
    "suppliers": SUPPLIERS,
    "packs": PACKS,
}

# Tables without which no fact can be built; a missing lookup only yields nulls.
FACT_SOURCES = ("orders", "order_lines")

# Their key columns; without one of them no row could be joined.
FACT_KEYS: dict[str, tuple[str, ...]] = {
    "orders": ("OrderId", "CustomerId", "SalesRepId", "ShippingMethodRequested"),
    "order_lines": ("OrderLineId", "OrderId", "ProductId", "ShipperId"),
}

# Columns projected by each scan (the source SELECT lists).
SCAN_COLUMNS: dict[str, list[str]] = {
    "orders": ["OrderId", "CustomerId", "SalesRepId", "CreatedAt_order", "DateOrdered",
               "DateExpected", "ShipDate", "ShippingMethodRequested"],
    "order_lines": ["OrderLineId", "OrderId", "ProductId", "ShipperId", "QuantityShipped",
                    "SalePrice", "UnitCost", "DateShipped"],
    "customers": [f.name for f in CUSTOMERS.fields],
    "products": [f.name for f in PRODUCTS.fields],
    "regions": ["RegionId", "RegionName"],
    "shippers": ["ShipperId", "Carrier"],
    "shipping_methods": ["SMId", "ShippingMethodName"],
    "suppliers": ["SupplierId", "SupplierName"],
    "packs": ["PickedForOrderLine", "WeightLb", "ItemCount", "DeliveryDate"],
}

FACT = _struct(
    ("OrderLineId", S), ("OrderId", S), ("ProductId", S), ("ShipperId", S),
    ("QuantityShipped", D), ("SalePrice", D), ("UnitCost", D), ("DateShipped", TS),
    ("CustomerId", S), ("SalesRepId", S), ("CreatedAt_order", TS), ("DateOrdered", TS),
    ("DateExpected", TS), ("ShipDate", TS), ("ShippingMethodRequested", S),
    ("CustomerName", S), ("RegionId", S), ("IsRetail", S), ("Address1", S),
    ("Address2", S), ("City", S), ("Province", S), ("PostalCode", S), ("Phone", S),
    ("Email", S), ("SupplierId", S), ("UnitOfBillingId", S), ("ProductName", S),
    ("ProductListPrice", S), ("CostPrice", S), ("RegionName", S), ("Carrier", S),
    ("ShippingMethodName", S), ("SupplierName", S), ("WeightLb", D), ("ItemCount", D),
    ("DeliveryDate", TS), ("Revenue", D), ("Cost", D), ("Profit", D), ("Date", DATE),
    ("TransitDays", L), ("DeliveryStatus", S),
)

# The columns every report needs; absent ones are added as typed nulls.
REPORT_REQUIRED: dict[str, DataType] = {
    "CustomerId": S, "CustomerName": S, "RegionName": S, "Address1": S, "Address2": S,
    "City": S, "Province": S, "PostalCode": S, "OrderId": S, "Revenue": D, "Cost": D,
    "Date": DATE, "WeightLb": D, "ItemCount": D, "ShippingMethodName": S, "Carrier": S,
    "ProductName": S, "ShipDate": TS,
}

CUSTOMER_AGG = _struct(
    ("CustomerId", S), ("CustomerName", S), ("RegionName", S), ("TotalRevenue", D),
    ("TotalCost", D), ("TotalOrders", L), ("TotalWeight", D), ("FirstOrder", DATE),
    ("LastOrder", DATE), ("Address", S), ("City", S), ("Province", S), ("PostalCode", S),
    ("AvgOrderWt", D), ("DaysSinceLastOrder", L), ("MonthsActive", L), ("RepeatRate", D),
    ("DeliveryTime", TS),
)
