"""Physical-plan shape: no pair explosions, no Python evaluation, bounded
single-partition steps only, partial group limits, joins chosen by the planner."""

from __future__ import annotations

import re

import pytest

from custlens.catalog import QUERIES, REPORTS
from custlens.config import DRIVER_PARAMS
from custlens.operators.fact import build_fact
from custlens.plans.context import Analysis
from custlens.sources.store import read_fact, write_fact
from tests.helpers import plan_text

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")

# Queries whose plans may hold single-partition exchanges, each over a bounded
# input: one-row totals, month rows, one row per range partition, or a result
# bounded by a dimension that is sorted for output (weekdays, segments,
# regions, cohort months, N rows per region).
BOUNDED_SINGLE = {
    "customer_kpis": 1, "load_sources": 9, "monthly_churn_trend": 2, "monthly_trend": 2,
    "monthly_trend_long": 2, "new_vs_returning": 1, "pareto": 1,
    "rfm_segments": 1, "churn_by_region": 1, "cohort_retention": 1,
    "weekday_revenue": 1, "top_customers_per_region": 1, "churn_by_region_180": 1,
    "churn_by_region_365": 1,
}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_plan_has_no_forbidden_operators(spark, key):
    plan = plan_text(QUERIES[key](spark, SF))
    for op in FORBIDDEN:
        assert op not in plan, f"{key}: {op}"
    assert plan.count("SinglePartition") <= BOUNDED_SINGLE.get(key, 0), key


@pytest.mark.parametrize("key", ["top_customers_per_region", "customer_profile", "recommend_customers"])
def test_group_limit_is_partial_before_shuffle(spark, key):
    plan = plan_text(QUERIES[key](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", plan) or "WindowGroupLimit" in plan
    head = plan.split("\n\n")[0]
    assert head.count("WindowGroupLimit") >= 2  # partial (map side) + final


def test_global_rank_window_is_partitioned(spark):
    plan = plan_text(QUERIES["pareto"](spark, SF))
    windows = re.findall(r"\(\d+\) Window\n.*?\nArguments: (.*?)\n", plan, re.S)
    # the running-sum/rank window is partitioned by range partition; the only
    # unpartitioned one runs over the per-partition offsets
    assert any("__gr_part" in w.split("]")[0] for w in windows)


def _without_broadcasts(spark, **more):
    return {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", **more}


@pytest.fixture()
def conf(spark):
    """Session settings for one test."""
    old = {}

    def put(settings):
        for k, v in settings.items():
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)

    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lines_move_at_most_once_per_large_join(spark, conf):
    """Lookups meet orders and products first: the lines are exchanged for packs,
    orders, products and shippers only, whatever the number of lookups."""
    conf(_without_broadcasts(spark, **{"spark.sql.adaptive.enabled": "false"}))
    plan = plan_text(Analysis.from_fixture(spark, SF, DRIVER_PARAMS).fact)
    tree = plan.split("\n\n")[0]
    assert tree.count("SortMergeJoin") == 9 and "BroadcastHashJoin" not in tree
    # Exchanges of rows that hold a line's price (SalePrice) and its packs' weight.
    moved = [x for x in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan) if "SalePrice" in x and "WeightLb" in x]
    assert len(moved) <= 3
    assert not any("CustomerName" in x and "Phone" in x and "Carrier" in x for x in moved)


def test_hot_customer_is_split_by_the_planner(spark, conf):
    """With AQE on and a customer that holds most orders, the customer join is skewed and split."""
    import datetime as dt
    from pyspark.sql import functions as F

    conf(_without_broadcasts(spark, **{
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}))
    raw = dict(Analysis.from_fixture(spark, SF, DRIVER_PARAMS).scanned)
    n = spark.range(40_000)
    orders = raw["orders"].limit(1).drop("OrderId", "CustomerId").join(
        n.select(F.col("id").cast("string").alias("OrderId"),
                 F.when(F.col("id") % 10 < 7, "1").otherwise(F.col("id").cast("string")).alias("CustomerId")))
    raw["orders"] = orders.repartition(16).select(raw["orders"].columns).checkpoint()
    fact = build_fact(raw, DRIVER_PARAMS)
    fact.write.format("noop").mode("overwrite").save()
    customers = raw["customers"].select("CustomerId", "CustomerName")
    joined = raw["orders"].join(customers, "CustomerId", "left")
    rows = joined.collect()
    assert len(rows) == 40_000
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    assert DRIVER_PARAMS.as_of > dt.date(2000, 1, 1)


def test_building_the_fact_starts_one_small_job(spark):
    a = Analysis.from_fixture(spark, SF, DRIVER_PARAMS)
    a.scanned
    spark.sparkContext.setJobGroup("fact-build", "plan only")
    try:
        a.fact
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fact-build")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 6  # the search for one order line, in growing steps, with its shuffles


@pytest.mark.parametrize("key", ["churn_by_region", "customer_kpis", "monthly_churn_trend", "tenure_histogram"])
def test_report_inputs_before_their_checkpoint(spark, key):
    """The customer stage under the reports: no forbidden operator, no single partition."""
    a = Analysis.from_fixture(spark, SF, DRIVER_PARAMS)
    plan = plan_text(a.customers)
    assert not any(op in plan for op in FORBIDDEN) and "SinglePartition" not in plan


def _scans(plan, table):
    """Scans of a table in a physical plan, reused exchanges not counted twice."""
    return len(re.findall(rf"Location: [^\n]*/{table}\b", plan))


def test_fact_build_reads_order_lines_and_packs_once(spark, scratch):
    from custlens.sources.fixture import fixture_sources
    from custlens.sources.scans import parquet_sources

    for name, df in fixture_sources(spark, SF).items():
        df.write.parquet(f"{scratch}/sources/{name}")
    plan = plan_text(Analysis(spark, DRIVER_PARAMS, raw=parquet_sources(spark, f"{scratch}/sources")).fact)
    assert [_scans(plan, t) for t in ("order_lines", "packs", "orders")] == [1, 1, 1]


def test_lines_meet_orders_before_packs(spark, conf):
    conf(_without_broadcasts(spark, **{"spark.sql.adaptive.enabled": "false"}))
    plan = plan_text(Analysis.from_fixture(spark, SF, DRIVER_PARAMS).fact)
    exchanged = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((\w+)#", plan)
    lines = [key for columns, key in exchanged if "SalePrice" in columns]
    assert lines.index("OrderId") < lines.index("OrderLineId")
    by_pack = next(columns for columns, key in exchanged if "SalePrice" in columns and key == "OrderLineId")
    assert "CustomerId" in by_pack  # the order is attached already


ROLLUP_REPORTS = ["customer_aggregates", "customer_kpis", "top10_revenue", "monthly_trend", "cohort_retention", "churn_by_region",
                  "monthly_churn_trend", "new_vs_returning", "top10_clv", "weekday_revenue", "top_customers_per_region",
                  "customer_profile", "customer_monthly_history", "filter_options", "export_customer_details"]


@pytest.fixture(scope="module")
def stored(spark):
    import tempfile

    path = tempfile.mkdtemp(prefix="custlens-test-", dir="/tmp") + "/fact"
    write_fact(Analysis.from_fixture(spark, SF, DRIVER_PARAMS).fact, path, DRIVER_PARAMS)
    return path


@pytest.mark.parametrize("key", ROLLUP_REPORTS)
def test_report_reads_the_stored_rollup_once_and_no_line(spark, stored, key):
    a = Analysis.from_store(spark, stored, DRIVER_PARAMS)
    plan = plan_text(REPORTS[key](a))
    assert _scans(plan, "lines") == 0
    # KPIs unite orders and customers, the monthly churn trend bounds and counts: two passes over the rollup.
    assert _scans(plan, "orders") <= (2 if key in ("customer_kpis", "monthly_churn_trend") else 1)


def test_reports_from_store_equal_those_from_lines(spark, stored):
    """Every report that reads the rollup, against the same report over the stored lines."""
    params = DRIVER_PARAMS.replace(start="1998-03-05", end="2000-02-20", regions=("ASIA", "EUROPE"))
    lines = read_fact(spark, stored).checkpoint()
    whole = Analysis(spark, params, fact=lines).store_customers()
    rolled = Analysis.from_store(spark, stored, params).store_customers()
    for key in ("customer_aggregates", "customer_kpis", "filter_options", "monthly_trend", "new_vs_returning",
                "weekday_revenue", "top_customers_per_region", "customer_monthly_history"):
        assert sorted(map(repr, REPORTS[key](rolled).collect())) == sorted(map(repr, REPORTS[key](whole).collect())), key


@pytest.mark.parametrize("key", ["customer_kpis", "pareto"])
def test_digits_do_not_depend_on_the_partitions(spark, conf, key):
    """Odd amounts, summed under other partition counts: equal to the last bit."""
    from pyspark.sql import functions as F

    fact = Analysis.from_fixture(spark, SF, DRIVER_PARAMS).fact
    fact = fact.withColumns({"Revenue": F.col("Revenue") * F.rand(3) / 7, "Cost": F.col("Cost") / 3}).checkpoint()
    seen = []
    for n in (1, 7):
        conf({"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.enabled": "false"})
        a = Analysis(spark, DRIVER_PARAMS, fact=fact.repartition(n))
        seen.append(sorted(map(repr, REPORTS[key](a).collect())))
    assert seen[0] == seen[1]


def test_rfm_orders_nobody(spark, monkeypatch):
    """No range exchange, no sort, no stored customers; the cache is given back."""
    a = Analysis.from_fixture(spark, SF, DRIVER_PARAMS)
    a.customers
    stored = []
    monkeypatch.setattr(type(a.customers), "checkpoint", lambda self, *x, **k: stored.append(self) or self)
    plan = plan_text(REPORTS["rfm_scores"](a))
    assert "rangepartitioning" not in plan and "InMemoryTableScan" not in plan and not stored
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_rank_inputs_are_slim(spark, monkeypatch):
    import importlib

    for module, call in (("pareto", "pareto"),):
        m = importlib.import_module(f"custlens.plans.{module}")
        seen, real = [], m.global_rank

        def watch(df, *a, _real=real, _seen=seen, **k):
            _seen.append([c for c in df.columns if not c.startswith("_")])
            return _real(df, *a, **k)

        monkeypatch.setattr(m, "global_rank", watch)
        getattr(m, call)(Analysis.from_fixture(spark, SF, DRIVER_PARAMS).customers)
        assert all(len(c) <= 6 for c in seen)


def test_fact_scan_prunes_columns(spark):
    plan = plan_text(QUERIES["top10_revenue"](spark, SF))
    lineitem_schema = re.search(r"lineitem\.parquet\]\n.*?ReadSchema: (struct<[^\n]*>)", plan, re.S)
    assert lineitem_schema and "l_tax" not in lineitem_schema.group(1)
