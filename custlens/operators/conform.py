"""Turn a stored fact into the report input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.dates import to_date_tolerant, to_timestamp_tolerant
from custlens.functions.numeric import to_double
from custlens.functions.text import py_strip
from custlens.schemas import REPORT_REQUIRED


def conform_fact(fact: DataFrame) -> DataFrame:
    """Backfill required columns, build ``Address``, parse dates and measures.

    Missing columns are added as typed nulls, so every report sees a stable
    schema whatever the fact's origin.
    """
    missing = {c: F.lit(None).cast(t) for c, t in REPORT_REQUIRED.items() if c not in fact.columns}
    df = fact.withColumns(missing) if missing else fact
    types = {f.name: f.dataType for f in df.schema.fields}
    address1 = py_strip(F.coalesce(F.col("Address1").cast("string"), F.lit("")))
    return df.withColumns({
        "Address1": address1,
        "Address2": py_strip(F.coalesce(F.col("Address2").cast("string"), F.lit(""))),
        "Address": address1,
        "Date": to_date_tolerant(F.col("Date"), types["Date"]),
        "ShipDate": to_timestamp_tolerant(F.col("ShipDate"), types["ShipDate"]),
        "WeightLb": to_double(F.col("WeightLb"), types["WeightLb"]),
        "ItemCount": to_double(F.col("ItemCount"), types["ItemCount"]),
        "Revenue": to_double(F.col("Revenue"), types["Revenue"]),
        "Cost": to_double(F.col("Cost"), types["Cost"]),
    })
