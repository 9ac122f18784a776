"""Cross-report invariants on the supplied tables."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from custlens import plans as P
from custlens.config import DRIVER_PARAMS
from custlens.operators.ordering import nice_step
from custlens.plans.context import Analysis

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def analysis(spark):
    a = Analysis.from_fixture(spark, SF, DRIVER_PARAMS.replace(top_n=5))
    a.filtered.persist()
    a.customers.persist()
    return a


def test_fact_rows_equal_line_order_join(analysis):
    # lookup keys are unique in the fixture, so lookups never fan out
    lines = analysis.scanned["order_lines"].join(analysis.scanned["orders"], "OrderId")
    assert analysis.fact.count() == lines.count()


def test_revenue_is_conserved(analysis):
    total = analysis.filtered.agg({"Revenue": "sum"}).first()[0]
    nvr = sum(r.Revenue for r in P.new_vs_returning(analysis.filtered).collect())
    kpi = P.customer_kpis(analysis.filtered, analysis.customers).first()
    cust = analysis.customers.agg({"TotalRevenue": "sum"}).first()[0]
    assert nvr == pytest.approx(total) and kpi.TotalRevenue == pytest.approx(total)
    assert cust == pytest.approx(total)


def test_pareto_and_segments(analysis):
    pareto = sorted(P.pareto(analysis.customers).collect(), key=lambda r: r.Rank)
    n = analysis.customers.count()
    assert [r.Rank for r in pareto] == list(range(1, n + 1))
    assert pareto[-1].CumulativePct == pytest.approx(1.0)
    segments = P.rfm_segments(P.rfm_scores(analysis.customers)).collect()
    assert sum(r.Count for r in segments) == n


def test_recommended_disjoint_from_top(analysis):
    both = P.compute_recommendations(analysis.filtered, 5, 500.0)
    top, rec = both["top"], both["recommended"]
    top_keys = {(r.RegionName, r.CustomerName) for r in top.collect()}
    rec_rows = rec.collect()
    assert rec_rows, "expected recommendations with N = 5"
    assert not top_keys & {(r.RegionName, r.CustomerName) for r in rec_rows}
    assert all(r.RegionName is not None for r in rec_rows)


def test_calendars_contiguous_and_monotone(analysis):
    months = sorted(r.month_ts for r in P.monthly_trend(analysis.filtered).collect())
    for a, b in zip(months, months[1:]):
        assert (b.year * 12 + b.month) - (a.year * 12 + a.month) == 1
    churn = sorted((r.Month, r.ChurnedCustomers)
                   for r in P.monthly_churn_trend(analysis.customers, 90).collect())
    assert len(churn) == len(months)
    assert all(a[1] <= b[1] for a, b in zip(churn, churn[1:]))
    last = months[-1]
    next_month = dt.date(last.year + last.month // 12, last.month % 12 + 1, 1)
    assert churn[-1][0] == next_month - dt.timedelta(days=1)


@settings(max_examples=300, deadline=None)
@given(span=st.floats(min_value=1e-6, max_value=1e9, allow_nan=False), bins=st.integers(1, 50))
def test_nice_step_is_smallest_valid(span, bins):
    import math

    step = nice_step(span, bins)
    assert math.ceil(span / step) <= bins
    # every candidate m * 10**k below the chosen one must be too fine
    candidates = sorted(m * 10.0 ** k for k in range(-20, 20) for m in (1, 2, 5))
    below = [c for c in candidates if c < step]
    assert below and math.ceil(span / below[-1]) > bins
