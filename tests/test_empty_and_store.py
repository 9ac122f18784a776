"""every report on an empty input keeps its schema; S13 read-or-build."""

from __future__ import annotations

import datetime as dt

import pytest

from custlens.catalog import REPORTS
from custlens.config import Params
from custlens.plans.context import Analysis
from custlens.schemas import FACT
from custlens.sources.store import load_or_build, read_fact, write_fact
from tests.helpers import plan_text

PARAMS = Params(start=dt.date(2001, 1, 1), end=dt.date(2001, 12, 31), as_of=dt.date(2002, 1, 1))


@pytest.fixture(scope="module")
def empty_analysis(spark):
    return Analysis(spark, PARAMS, fact=spark.createDataFrame([], FACT))


@pytest.mark.parametrize("key", sorted(REPORTS))
def test_report_on_empty_input(spark, empty_analysis, key):
    df = REPORTS[key](empty_analysis)
    rows = df.collect()
    if key == "new_vs_returning":
        assert sorted(r.Revenue for r in rows) == [0.0, 0.0]
    elif key == "customer_kpis":
        assert len(rows) == 1 and rows[0].TotalCustomers == 0
    else:
        assert rows == []
    assert df.columns  # schema survives


def _fact_rows(spark, *days):
    row = {f.name: None for f in FACT.fields}
    rows = [{**row, "OrderLineId": f"L{i}", "OrderId": "1", "Revenue": 5.0, "Date": d} for i, d in enumerate(days)]
    return spark.createDataFrame([tuple(r[f.name] for f in FACT.fields) for r in rows], FACT)


STORED = Params(fetch_start="2001-01-01", fetch_end="2001-12-31", start="2001-01-01", end="2001-12-31", as_of="2002-01-01")


def test_load_or_build_reads_what_covers_the_request(spark, scratch):
    calls = []

    def build():
        calls.append(1)
        return _fact_rows(spark, dt.date(2001, 2, 3), dt.date(2001, 7, 1))

    path = f"{scratch}/fact"
    assert load_or_build(spark, path, build, STORED).count() == 2
    assert load_or_build(spark, path, build, STORED).count() == 2 and len(calls) == 1
    inner = STORED.replace(fetch_start="2001-02-01", start="2001-07-01")
    part = load_or_build(spark, path, build, inner)
    assert len(calls) == 1 and part.count() == 1
    assert "PartitionFilters: [isnotnull(OrderMonth" in plan_text(part)
    load_or_build(spark, path, build, STORED, rebuild=True)
    assert len(calls) == 2
    assert read_fact(spark, path, dt.date(2001, 3, 1), dt.date(2001, 6, 30)).count() == 0


@pytest.mark.parametrize("change", [
    {"fetch_start": "2000-12-31"}, {"fetch_end": "2002-01-01"}, {"packed_status": "other"}])
def test_stale_fact_is_rebuilt(spark, scratch, change):
    calls = []

    def build():
        calls.append(1)
        return _fact_rows(spark, dt.date(2001, 2, 3))

    load_or_build(spark, f"{scratch}/fact", build, STORED)
    load_or_build(spark, f"{scratch}/fact", build, STORED.replace(**change))
    assert len(calls) == 2


@pytest.mark.parametrize("damage", ["corrupt", "missing", "no record"])
def test_damaged_fact_is_rebuilt(spark, scratch, damage):
    import glob
    import os

    path, calls = f"{scratch}/fact", []

    def build():
        calls.append(1)
        return _fact_rows(spark, dt.date(2001, 2, 3), dt.date(2001, 7, 1))

    load_or_build(spark, path, build, STORED)
    part = sorted(glob.glob(f"{path}/data/*/lines/OrderMonth=*/*.parquet"))[0]
    if damage == "corrupt":
        with open(part, "wb") as f:
            f.write(b"not parquet at all")
        for crc in glob.glob(os.path.join(os.path.dirname(part), ".*.crc")):
            os.remove(crc)
    elif damage == "missing":
        os.remove(part)
    else:
        write_fact(build(), path)
        calls.clear()
        calls.append(1)
    assert load_or_build(spark, path, build, STORED).count() == 2
    assert len(calls) == 2


def test_export_sinks(spark, scratch):
    from custlens.sources.store import write_table

    df = spark.createDataFrame([("1", 2.5), ("2", None)], "CustomerId string, GrossProfit double")
    write_table(df, f"{scratch}/csv", "csv")
    back = spark.read.option("header", "true").csv(f"{scratch}/csv")
    assert back.columns == ["CustomerId", "GrossProfit"] and back.count() == 2
    write_table(df, f"{scratch}/pq", "parquet")
    assert sorted(map(tuple, spark.read.parquet(f"{scratch}/pq").collect()), key=str) == [("1", 2.5), ("2", None)]
    with pytest.raises(ValueError):
        write_table(df, f"{scratch}/x", "xlsx")
