"""RFM scores: hand-computed cases, quarters of positions, edge sizes, ordering helper."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from custlens.operators.ordering import global_rank
from custlens.plans.rfm import rfm_scores, rfm_segments
from pyspark.sql import functions as F

DDL = "CustomerId string, CustomerName string, RegionName string, TotalOrders bigint, " \
      "TotalRevenue double, DaysSinceLastOrder bigint"


def _customers(spark, n, seed, distinct_recency=True):
    rng = np.random.default_rng(seed)
    orders = rng.integers(1, 6, n)              # many ties in frequency
    revenue = rng.integers(0, 40, n) * 10.0     # ties in revenue too
    recency = rng.permutation(n * 3)[:n] if distinct_recency else rng.integers(0, 4, n)
    rows = [(f"c{i:03d}", f"N{i}", "R", int(orders[i]), float(revenue[i]), int(recency[i])) for i in range(n)]
    return spark.createDataFrame(rows, DDL), rows


def _quarter(position, n):
    """Quarter 1..4 of a 0-based position among n ordered ones: the edges lie at
    (n - 1) / 4, (n - 1) / 2 and 3 (n - 1) / 4, and a position on an edge counts below it."""
    return next(k for k in (1, 2, 3, 4) if 4 * position <= k * (n - 1))


# Scores worked out by hand: id, orders, revenue, days -> R, F, M.
HAND = [
    # four customers: positions 0, 1, 2, 3 against edges 0.75, 1.5, 2.25
    ([("a", 9, 90.0, 1), ("b", 7, 70.0, 2), ("c", 5, 50.0, 3), ("d", 3, 30.0, 4)],
     {"a": (4, 1, 1), "b": (3, 2, 2), "c": (2, 3, 3), "d": (1, 4, 4)}),
    # five: positions 0..4 against edges 1, 2, 3, each on its edge counting below it
    ([("a", 9, 90.0, 1), ("b", 7, 70.0, 2), ("c", 5, 50.0, 3), ("d", 3, 30.0, 4), ("e", 1, 10.0, 5)],
     {"a": (4, 1, 1), "b": (4, 1, 1), "c": (3, 2, 2), "d": (2, 3, 3), "e": (1, 4, 4)}),
    # ties: equal orders are ranked by revenue, equal revenue by id
    ([("a", 5, 10.0, 40), ("b", 5, 30.0, 30), ("c", 5, 30.0, 20), ("d", 8, 10.0, 10)],
     {"a": (1, 4, 3), "b": (2, 2, 1), "c": (3, 3, 2), "d": (4, 1, 4)}),
]


@pytest.mark.parametrize("case", range(len(HAND)))
def test_rfm_hand_computed(spark, case):
    rows, want = HAND[case]
    df = spark.createDataFrame([(i, i.upper(), "R", o, v, d) for i, o, v, d in rows], DDL)
    got = {r.CustomerId: (r.RecencyScore, r.FrequencyScore, r.MonetaryScore) for r in rfm_scores(df).collect()}
    assert got == want


@pytest.mark.parametrize("n,seed", [(6, 3), (7, 4), (9, 5), (30, 6), (101, 7)])
def test_rfm_quarters_of_positions(spark, n, seed):
    df, rows = _customers(spark, n, seed)
    by_orders = sorted(rows, key=lambda r: (-r[3], -r[4], r[0]))
    by_revenue = sorted(rows, key=lambda r: (-r[4], r[0]))
    by_days = sorted(rows, key=lambda r: r[5])
    got = {r.CustomerId: r for r in rfm_scores(df).collect()}
    for score, ordered, flip in (("FrequencyScore", by_orders, 0), ("MonetaryScore", by_revenue, 0),
                                 ("RecencyScore", by_days, 5)):
        want = {r[0]: _quarter(i, n) for i, r in enumerate(ordered)}
        assert {c: abs(flip - r[score]) for c, r in got.items()} == want


@pytest.mark.parametrize("n", [1, 2, 3])
def test_rfm_tiny_inputs_do_not_fail(spark, n):
    sdf, _ = _customers(spark, n, 11)
    rows = rfm_scores(sdf).collect()
    assert len(rows) == n
    # with distinct ranks 1..n: rank 1 always scores 1 (largest customer)
    top = min(rows, key=lambda r: (-r.Frequency, -r.Monetary, r.CustomerId))
    assert top.FrequencyScore == 1


def test_rfm_tied_recency_edges(spark):
    sdf, _ = _customers(spark, 12, 3, distinct_recency=False)
    rows = rfm_scores(sdf).collect()
    assert {r.RecencyScore for r in rows} <= {1, 2, 3, 4}
    seg = {r.RFM_Segment: r.Count for r in rfm_segments(rfm_scores(sdf)).collect()}
    assert sum(seg.values()) == 12
    names = {12: "Champion", 10: "Champion", 9: "Loyal", 8: "Loyal", 7: "At Risk", 6: "At Risk", 5: "Dormant", 3: "Dormant"}
    for r in rows:
        assert r.RFM_Segment == names.get(r.RFM_Score, r.RFM_Segment)


def test_high_is_good_flips_fm(spark):
    sdf, _ = _customers(spark, 20, 9)
    a = {r.CustomerId: r for r in rfm_scores(sdf).collect()}
    b = {r.CustomerId: r for r in rfm_scores(sdf, fm_direction="high_is_good").collect()}
    assert all(a[k].FrequencyScore + b[k].FrequencyScore == 5 for k in a)
    assert all(a[k].RecencyScore == b[k].RecencyScore for k in a)


def test_global_rank_matches_single_partition_window(spark):
    rng = np.random.default_rng(0)
    rows = [(f"k{i:05d}", float(rng.integers(0, 50))) for i in range(3000)]  # heavy ties
    df = spark.createDataFrame(rows, "k string, v double")
    order = [F.desc("v"), F.asc("k")]
    got = global_rank(df, order, rank_col="r", sum_col="v", cum_col="cum", total_col="tot",
                      count_col="n", num_partitions=7)
    got = {r.k: (r.r, r.cum, r.tot, r.n) for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"]).sort_values(["v", "k"], ascending=[False, True])
    pdf["r"] = np.arange(1, len(pdf) + 1)
    pdf["cum"] = pdf["v"].cumsum()
    expected = {r.k: (r.r, r.cum, pdf["v"].sum(), len(pdf)) for r in pdf.itertuples()}
    assert got == expected
