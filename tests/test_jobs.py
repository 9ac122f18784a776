"""Batch entry points on the smallest supplied tables."""

from __future__ import annotations

import pytest

from custlens import jobs
from custlens.sources.store import read_fact

SF = "/root/testdata/sf0.001"
ARGS = ["--fetch-start", "1996-01-01", "--fetch-end", "2001-06-30", "--start", "1996-01-01",
        "--end", "2001-06-30", "--as-of", "2001-08-02", "--packed-status", "F"]


def test_build_fact_then_reports(spark, scratch):
    fact = f"{scratch}/fact"
    jobs.main(["build-fact", "--fixture-dir", SF, "--fact", fact, *ARGS], spark=spark)
    written = jobs.main(["report", "top10_revenue", "weekday_revenue", "--fact", fact,
                         "--out", f"{scratch}/out", "--format", "csv", *ARGS], spark=spark)
    assert [p.rsplit("/", 1)[1] for p in written] == ["top10_revenue", "weekday_revenue"]
    top = spark.read.option("header", "true").csv(written[0])
    assert top.count() == 10 and "RetentionRate" in top.columns


def test_build_fact_from_parquet_sources_matches_fixture(spark, scratch):
    from custlens.config import Params
    from custlens.plans.context import Analysis
    from custlens.sources.fixture import fixture_sources
    from custlens.sources.store import read_fact

    for name, df in fixture_sources(spark, SF).items():
        df.write.mode("overwrite").parquet(f"{scratch}/sources/{name}")
    fact = f"{scratch}/fact"
    jobs.main(["build-fact", "--sources", f"{scratch}/sources", "--fact", fact, *ARGS], spark=spark)
    params = Params(fetch_start="1996-01-01", fetch_end="2001-06-30", start="1996-01-01",
                    end="2001-06-30", as_of="2001-08-02", packed_status="F")
    expected = Analysis.from_fixture(spark, SF, params).fact
    got = read_fact(spark, fact)
    assert got.count() == expected.count() > 0
    assert got.exceptAll(expected.select(got.columns)).count() == 0


def test_report_with_a_source_reads_only_its_months(spark, scratch, monkeypatch):
    from custlens.plans.context import Analysis
    from tests.helpers import plan_text

    seen = []
    monkeypatch.setitem(jobs.REPORTS, "weekday_revenue", lambda a: seen.append(a) or a.filtered.select("OrderId"))
    month = [*ARGS[:4], "--start", "1998-03-01", "--end", "1998-03-31", *ARGS[8:]]
    jobs.main(["report", "weekday_revenue", "--fixture-dir", SF, "--fact", f"{scratch}/fact", "--out", f"{scratch}/out", *month],
              spark=spark)
    assert isinstance(seen[0], Analysis)
    plan = plan_text(seen[0].filtered)
    assert "PartitionFilters: [isnotnull(OrderMonth" in plan and "1998-03-01" in plan


def test_report_without_a_source_needs_a_covering_fact(spark, scratch):
    fact = f"{scratch}/fact"
    short = [*ARGS[:2], "--fetch-end", "1999-12-31", *ARGS[4:]]
    jobs.main(["build-fact", "--fixture-dir", SF, "--fact", fact, *short], spark=spark)
    with pytest.raises(ValueError, match="1999-12-31"):
        jobs.main(["report", "weekday_revenue", "--fact", fact, "--out", f"{scratch}/out", *ARGS], spark=spark)
    with pytest.raises(ValueError, match="no complete snapshot"):
        jobs.main(["report", "weekday_revenue", "--fact", f"{scratch}/none", "--out", f"{scratch}/out", *ARGS], spark=spark)
    months = jobs.main(["refresh-fact", "--fixture-dir", SF, "--fact", fact, *ARGS], spark=spark)
    assert "2000-01-01" in months and max(months) == "2001-06-01"
    jobs.main(["report", "weekday_revenue", "--fact", fact, "--out", f"{scratch}/out", "--format", "csv", "--check", *ARGS], spark=spark)


def test_drilldown_job(spark, scratch):
    fact = f"{scratch}/fact"
    jobs.main(["build-fact", "--fixture-dir", SF, "--fact", fact, *ARGS], spark=spark)
    name = read_fact(spark, fact).where("CustomerName is not null").first()["CustomerName"]
    out = jobs.main(["report", "top10_revenue", "--drilldown", name, "--fact", fact, "--out", f"{scratch}/out", *ARGS], spark=spark)
    assert [p.rsplit("/", 1)[1] for p in out] == [
        "top10_revenue", "drilldown_profile", "drilldown_monthly_history", "drilldown_category_mix"]
    profile = spark.read.parquet(out[1]).collect()
    assert [r["CustomerName"] for r in profile] == [name]
    assert {r["CustomerId"] for r in spark.read.parquet(out[2]).collect()} == {profile[0]["CustomerId"]}


def _args(*more):
    return jobs.parser().parse_args(["build-fact", "--fact", "x", *more])


def test_jdbc_options(monkeypatch):
    from custlens.sources.scans import jdbc_sources

    monkeypatch.setenv("DB_SECRET", "s3cret")
    args = _args("--jdbc-url", "jdbc:x", "--jdbc-option", "user=u", "--jdbc-password-env", "DB_SECRET",
                 "--jdbc-partition", "orders:OrderId:1:900:8", "--jdbc-partition",
                 "order_lines:CreatedAt:2020-01-01 00:00:00:2026-01-01 00:00:00:16")
    assert jobs.jdbc_options(args) == {"user": "u", "password": "s3cret"}
    parts = jobs.jdbc_partitioning(args)
    assert parts["orders"] == {"partitionColumn": "OrderId", "lowerBound": "1", "upperBound": "900", "numPartitions": "8"}
    assert parts["order_lines"]["lowerBound"] == "2020-01-01 00:00:00" and parts["order_lines"]["upperBound"] == "2026-01-01 00:00:00"
    for bad in (["--jdbc-option", "password=x"], ["--jdbc-option", "partitionColumn=OrderId"]):
        with pytest.raises(SystemExit):
            jobs.jdbc_options(_args(*bad))
    # Packs are not partitioned: refused before anything is read.
    with pytest.raises(ValueError, match="packs"):
        jdbc_sources(None, "jdbc:x", {}, parts)
