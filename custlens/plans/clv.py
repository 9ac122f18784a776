"""Customer lifetime value and gross margin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.numeric import rint2, safe_divide
from custlens.plans.common import top_k

# Fixed value: lifetime horizon in years used by the CLV projection.
LIFE_YEARS = 3


def customer_clv(customers: DataFrame, life_years: int = LIFE_YEARS) -> DataFrame:
    """Average order value, orders per year, CLV and gross margin per customer.

    The operation order of the original is kept (it is not simplified
    algebraically) so the doubles round identically.
    """
    aov = F.coalesce(safe_divide(F.col("TotalRevenue"), F.col("TotalOrders")), F.lit(0.0))
    # MonthsActive is 1 at least.
    per_year = F.coalesce(F.col("TotalOrders") / F.col("MonthsActive") * 12, F.lit(0.0))
    margin = F.coalesce(
        rint2(safe_divide(F.col("TotalRevenue") - F.col("TotalCost"), F.col("TotalRevenue")) * 100),
        F.lit(0.0),
    )
    return customers.withColumns({
        "AvgOrderValue": aov, "OrdersPerYear": per_year,
    }).withColumns({
        "CLV": rint2(F.col("AvgOrderValue") * F.col("OrdersPerYear") * life_years),
        "GrossMarginPct": margin,
    }).select(
        "CustomerId", "CustomerName", "RegionName", "TotalRevenue", "TotalCost", "TotalOrders",
        "MonthsActive", "AvgOrderValue", "OrdersPerYear", "CLV", "GrossMarginPct",
    )


def top10_clv(clv: DataFrame, k: int = 10) -> DataFrame:
    """T4: highest CLV (ties: CustomerId ascending)."""
    order = [F.desc_nulls_last("CLV"), F.asc_nulls_last("CustomerId")]
    return top_k(clv, order, k).select(
        "CustomerName", "RegionName", "AvgOrderValue", "OrdersPerYear", "CLV"
    )


def gross_margin(clv: DataFrame) -> DataFrame:
    """Gross margin % per customer (0 when revenue is 0), highest first."""
    return clv.select(
        "CustomerId", "CustomerName", "TotalRevenue", "TotalCost", "GrossMarginPct", "CLV"
    ).orderBy(F.desc("GrossMarginPct"), F.asc_nulls_last("CustomerId"))


def profit_vs_volume(clv: DataFrame) -> DataFrame:
    """Revenue, orders, margin and CLV per customer (scatter data)."""
    return clv.select("CustomerId", "CustomerName", "TotalRevenue", "TotalOrders", "GrossMarginPct", "CLV")
