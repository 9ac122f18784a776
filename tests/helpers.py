"""Hand-made report inputs for edge-case tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from custlens.schemas import REPORT_REQUIRED

REPORT_DDL = ", ".join(f"{c} {t.simpleString()}" for c, t in REPORT_REQUIRED.items())

DEFAULTS = {
    "CustomerId": "1", "CustomerName": "Alpha", "RegionName": "EAST", "Address1": "1 Main St",
    "Address2": "", "City": "Town", "Province": "PR", "PostalCode": "00001", "OrderId": "o1",
    "Revenue": 100.0, "Cost": 60.0, "Date": dt.date(2001, 1, 15), "WeightLb": 10.0,
    "ItemCount": 1.0, "ShippingMethodName": "GROUND", "Carrier": "C1", "ProductName": "Beef – Ribeye",
    "ShipDate": dt.datetime(2001, 1, 16, 13, 0),
}


def report_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A report input (conformed fact) with the 18 required columns + Address."""
    full = [tuple({**DEFAULTS, **r}[c] for c in REPORT_REQUIRED) for r in rows]
    df = spark.createDataFrame(full, REPORT_DDL)
    from custlens.operators.conform import conform_fact

    return conform_fact(df)


def collect_dicts(df: DataFrame, order: list[str] | None = None) -> list[dict]:
    rows = [r.asDict() for r in df.collect()]
    if order:
        rows.sort(key=lambda r: tuple((r[k] is None, r[k]) for k in order))
    return rows


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as printed by ``DataFrame.explain``."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
