"""Pareto curve of revenue over customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.functions.numeric import safe_divide
from custlens.operators.ordering import global_rank


def pareto(customers: DataFrame) -> DataFrame:
    """Rank by revenue (ties: CustomerId), running revenue and its share of the total.

    Ranks and the running sum come from :func:`global_rank` (range partitions
    plus per-partition offsets), never from a single-task window.
    """
    ranked = global_rank(
        customers.select("CustomerId", "CustomerName", "TotalRevenue"),
        [F.desc_nulls_last("TotalRevenue"), F.asc_nulls_last("CustomerId")],
        rank_col="Rank",
        sum_col="TotalRevenue",
        cum_col="CumulativeRevenue",
        total_col="_total",
    )
    return ranked.select(
        "CustomerId",
        "CustomerName",
        "TotalRevenue",
        "Rank",
        "CumulativeRevenue",
        safe_divide(F.col("CumulativeRevenue"), F.col("_total")).alias("CumulativePct"),
    )
