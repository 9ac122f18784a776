"""RFM scores and segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from custlens.operators.selection import ascending_text, at_or_before, descending, keys_at_ranks
from custlens.plans.common import sort_bounded, top_k

# Segment thresholds on RFM_Score (3..12) and their names.
SEGMENTS = [(10, "Champion"), (8, "Loyal"), (6, "At Risk")]
DEFAULT_SEGMENT = "Dormant"


def _quartile_ranks(n: int) -> list[int]:
    """The last rank of the first three quartiles of ranks 1..n.

    Edges are the linearly interpolated 25/50/75 % points of 1..n, 1 + (n-1)p, with
    right-closed bins.  This is not ``ntile(4)``; the two differ when n mod 4 is 2 or 3.
    """
    return [math.floor(1 + (n - 1) * p) for p in (0.25, 0.5, 0.75)]


def _quartile(order: list, cuts: list[tuple]):
    """Quartile label 1..4 of a row by the keys at the quartiles' last ranks."""
    label = F.lit(4)
    for q in (2, 1, 0):
        label = F.when(at_or_before(order, cuts[q]), q + 1).otherwise(label)
    return label


def rfm_scores(customers: DataFrame, fm_direction: str = "as_reference", stored: bool = False) -> DataFrame:
    """Recency, frequency and monetary quartile scores per customer.

    * Recency: quartile of DaysSinceLastOrder at the interpolated 25/50/75 %
      points, right-closed; label 4 for the most recent quarter down to 1.
      The three points come from Spark's exact ``percentile``; its state holds
      one entry per distinct day count, bounded by the date span.
    * Frequency / Monetary: quartile of a customer's rank (1 = most orders / most
      revenue; ties by revenue, then id).  The customers at the quartiles' edges are
      found by :func:`keys_at_ranks`, a few counting passes over slim rows; nobody is
      sorted or moved, and every customer is compared with three keys.  As in the
      original, the *largest* customers get score 1 (``fm_direction=
      "as_reference"``); ``"high_is_good"`` flips them to 4.
    * Tied quartile edges never fail; the first matching band wins.

    The passes read the customers' four measures from Spark's cache, which is given back
    before this returns (``stored`` customers, in a table already, are read as they are).
    A cached part that is lost is computed again to the same digits, for sums are exact.
    """
    if fm_direction not in ("as_reference", "high_is_good"):
        raise ValueError(f"unknown fm_direction: {fm_direction}")
    base = customers.select(
        "CustomerId", "CustomerName", "RegionName", F.col("DaysSinceLastOrder").alias("Recency"),
        F.col("TotalOrders").alias("Frequency"), F.col("TotalRevenue").alias("Monetary"))
    money, who = descending("Monetary"), ascending_text("CustomerId")
    orders = [[*descending("Frequency"), *money, *who], [*money, *who]]
    kinds = [["double", "int"] * 2 + ["int", "text"], ["double", "int", "int", "text"]]
    slim = base.select("CustomerId", "Recency", "Frequency", "Monetary")
    if not stored:
        slim = slim.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        whole = slim.agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col("Recency"), [0.25, 0.5, 0.75]).alias("q")).first()
        ranks = _quartile_ranks(whole["n"]) if whole["n"] else []
        cuts = keys_at_ranks(slim, orders, kinds, [ranks, ranks])
    finally:
        if not stored:
            slim.unpersist()
    q = whole["q"] or [None, None, None]
    recency = F.col("Recency")
    recency_score = (
        F.when(recency <= F.lit(q[0]), 4)
        .when(recency <= F.lit(q[1]), 3)
        .when(recency <= F.lit(q[2]), 2)
        .otherwise(1)
    )
    freq_score, money_score = (_quartile(o, c) if c else F.lit(4) for o, c in zip(orders, cuts))
    if fm_direction == "high_is_good":
        freq_score, money_score = 5 - freq_score, 5 - money_score
    scored = base.withColumns({
        "RecencyScore": recency_score.cast("int"),
        "FrequencyScore": freq_score.cast("int"),
        "MonetaryScore": money_score.cast("int"),
    }).withColumn("RFM_Score", F.col("RecencyScore") + F.col("FrequencyScore") + F.col("MonetaryScore"))
    segment = F.lit(DEFAULT_SEGMENT)
    for threshold, name in reversed(SEGMENTS):
        segment = F.when(F.col("RFM_Score") >= threshold, name).otherwise(segment)
    return scored.withColumn("RFM_Segment", segment).select(
        "CustomerId", "CustomerName", "RegionName", "Recency", "Frequency", "Monetary",
        "RecencyScore", "FrequencyScore", "MonetaryScore", "RFM_Score", "RFM_Segment",
    )


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """Customers per segment (non-null ids counted)."""
    counts = rfm.groupBy("RFM_Segment").agg(F.count("CustomerId").alias("Count"))
    return sort_bounded(counts, F.desc("Count"), F.asc("RFM_Segment"))


def top10_rfm(rfm: DataFrame, k: int = 10) -> DataFrame:
    """Highest RFM scores (ties: revenue descending, then CustomerId)."""
    order = [F.desc_nulls_last("RFM_Score"), F.desc_nulls_last("Monetary"), F.asc_nulls_last("CustomerId")]
    return top_k(rfm, order, k).select(
        "CustomerName",
        "RegionName",
        F.col("RFM_Score").alias("RFM"),
        F.col("Recency").alias("Days Since Last"),
        F.col("Frequency").alias("Orders"),
        F.col("Monetary").alias("Revenue"),
    )
