"""Snapshots of the stored fact, refresh, drilldown reads, sources that fail, exports."""

from __future__ import annotations

import datetime as dt
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from custlens.config import Params
from custlens.plans.context import Analysis
from custlens.schemas import FACT
from custlens.sources import store
from custlens.sources.scans import parquet_sources, scan_sources
from tests.test_fact import PARAMS, _sources

D = dt.date
YEAR = Params(fetch_start="2001-01-01", fetch_end="2001-12-31", start="2001-01-01", end="2001-12-31", as_of="2002-01-01")


def fact(spark, *rows):
    """Fact rows from (order, day, customer, revenue)."""
    empty = {f.name: None for f in FACT.fields}
    full = [{**empty, "OrderLineId": f"L{i}", "OrderId": o, "Date": d, "CustomerId": c, "Revenue": r, "Cost": 0.0, "WeightLb": 0.0}
            for i, (o, d, c, r) in enumerate(rows)]
    return spark.createDataFrame([tuple(x[f.name] for f in FACT.fields) for x in full], FACT)


def orders_of(df):
    return sorted(r.OrderId for r in df.collect())


def test_a_killed_write_leaves_the_last_snapshot(spark, scratch, monkeypatch):
    path = f"{scratch}/fact"
    store.write_fact(fact(spark, ("1", D(2001, 2, 1), "a", 5.0)), path, YEAR)
    second = fact(spark, ("2", D(2001, 3, 1), "a", 5.0))
    for step in ("_write", "_finish", "_commit"):
        real = getattr(store, step)

        def killed(*a, _real=real, _step=step, **k):
            if _step == "_write":
                _real(*a, **k)  # the lines are there, the rollup is not
            raise KeyboardInterrupt

        monkeypatch.setattr(store, step, killed)
        with pytest.raises(KeyboardInterrupt):
            store.write_fact(second, path, YEAR)
        monkeypatch.setattr(store, step, real)
        assert orders_of(store.read_fact(spark, path)) == ["1"] and store.fact_covers(spark, path, YEAR)
    assert store.write_fact(second, path, YEAR) >= 2
    assert orders_of(store.read_fact(spark, path)) == ["2"]
    assert orders_of(store.read_fact(spark, path, snapshot=1)) == ["1"]  # the older one is still there
    data = f"{path}/data"
    assert len(os.listdir(data)) == 5
    assert store.expire_snapshots(spark, path, keep=1) == 4 and len(os.listdir(data)) == 1
    assert orders_of(store.read_fact(spark, path)) == ["2"] and store.fact_covers(spark, path, YEAR)
    assert store.expire_snapshots(spark, path, keep=0) == 0


def test_two_writers_do_not_both_commit_a_number(spark, scratch, monkeypatch):
    path = f"{scratch}/fact"
    one = fact(spark, ("1", D(2001, 2, 1), "a", 5.0))
    store.write_fact(one, path, YEAR)
    taken = store.files.names
    monkeypatch.setattr(store.files, "names", lambda s, p: [] if p.endswith(("manifests", "commits")) else taken(s, p))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.write_fact(one, path, YEAR)


def test_rows_without_a_date_and_an_empty_fact(spark, scratch):
    store.write_fact(fact(spark, ("1", None, None, 5.0), ("2", D(2001, 2, 1), "a", 1.0)), f"{scratch}/a", YEAR)
    assert orders_of(store.read_fact(spark, f"{scratch}/a")) == ["1", "2"]
    assert orders_of(store.read_fact(spark, f"{scratch}/a", D(2001, 1, 1), D(2001, 12, 1))) == ["2"]
    store.write_fact(fact(spark), f"{scratch}/b", YEAR)
    assert store.fact_info(spark, f"{scratch}/b")["n_rows"] == 0 and store.fact_covers(spark, f"{scratch}/b", YEAR)
    a = Analysis.from_store(spark, f"{scratch}/b", YEAR)
    assert a.customers.collect() == [] and a.filtered.collect() == []


def _raw(spark):
    """Orders of March to June; one line of March's order was created in June."""
    raw = _sources(spark)
    T = dt.datetime
    o = raw["orders"].schema
    base = dict(SalesRepId="r", OrderStatus="packed", ShippingMethodRequested="G", CustomerId="c1")
    days = {"1": T(2001, 3, 1, 9), "2": T(2001, 4, 1, 9), "5": T(2001, 5, 7), "6": T(2001, 6, 7)}
    rows = [dict(base, OrderId=k, CreatedAt_order=t, ShipDate=t) for k, t in days.items()]
    raw["orders"] = spark.createDataFrame([tuple(r.get(f.name) for f in o.fields) for r in rows], o)
    li = raw["order_lines"].schema
    lines = [("L1", "1", T(2001, 3, 1)), ("L2", "1", T(2001, 6, 2)), ("L3", "2", T(2001, 4, 1)), ("L5", "5", T(2001, 5, 8)), ("L6", "6", T(2001, 6, 8))]
    rows = [dict(OrderLineId=a, OrderId=b, ProductId="p1", ShipperId="s9", SalePrice=2.0, UnitCost=1.0, CreatedAt=t) for a, b, t in lines]
    raw["order_lines"] = spark.createDataFrame([tuple(r.get(f.name) for f in li.fields) for r in rows], li)
    return raw


def test_refresh_writes_only_months_with_new_rows(spark, scratch):
    path, raw = f"{scratch}/fact", _raw(spark)

    def build(sources, p=PARAMS):
        return Analysis(spark, p, raw=sources).fact

    april = PARAMS.replace(fetch_end="2001-05-31", end="2001-05-31")
    store.write_fact(build(raw, april), path, april)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/*/lines/*/*.parquet")}
    months = store.refresh_fact(spark, path, raw, PARAMS, build)
    assert months == [D(2001, 3, 1), D(2001, 6, 1)]  # March for its late line
    after = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/*/lines/*/*.parquet")}
    assert before.items() <= after.items()
    assert {f.split("OrderMonth=")[1][:10] for f in set(after) - set(before)} == {"2001-03-01", "2001-06-01"}
    got, want = store.read_fact(spark, path), build(raw)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    whole = f"{scratch}/whole"
    store.write_fact(want, whole, PARAMS)
    for table in ("orders", "customers"):
        assert sorted(map(repr, store.read_table(spark, path, table).collect())) == sorted(map(repr, store.read_table(spark, whole, table).collect()))
    assert store.fact_covers(spark, path, PARAMS)
    assert store.refresh_fact(spark, path, raw, PARAMS, build) == [] and orders_of(store.read_fact(spark, path)) == orders_of(want)
    assert store.refresh_fact(spark, path, raw, PARAMS, build, since=D(2001, 5, 20)) == [D(2001, 5, 1), D(2001, 6, 1)]
    assert orders_of(store.read_fact(spark, path)) == orders_of(want)
    # Another status, or a range that does not hold the stored one: everything is built.
    assert store.refresh_fact(spark, path, raw, PARAMS.replace(fetch_start="2001-04-01"), build) != []


def test_coverage_looks_at_the_months_of_the_request(spark, scratch):
    path = f"{scratch}/fact"
    store.write_fact(fact(spark, ("1", D(2001, 2, 1), "a", 5.0), ("2", D(2001, 7, 1), "a", 5.0)), path, YEAR)
    os.remove(glob.glob(f"{path}/data/*/lines/OrderMonth=2001-07-01/*.parquet")[0])
    assert not store.fact_covers(spark, path, YEAR)
    assert store.fact_covers(spark, path, YEAR.replace(start="2001-01-01", end="2001-06-30"))
    with pytest.raises(ValueError, match="needs"):
        store.require_covered(spark, path, YEAR)


def _scan_rows(df):
    """Rows that the file scans of an executed plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().get("numOutputRows").get().value()
    return total


def test_one_customer_reads_few_row_groups(spark, scratch):
    path, n = f"{scratch}/fact", 6000
    rows = spark.range(n).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in FACT.fields if f.name not in ("CustomerId", "OrderId", "Date", "Revenue")],
        F.format_string("c%04d", F.col("id") % 300).alias("CustomerId"), F.col("id").cast("string").alias("OrderId"),
        F.lit(D(2001, 5, 5)).alias("Date"), F.lit(1.0).alias("Revenue"))
    store.write_fact(rows.repartition(5), path, YEAR, {"parquet.block.size": "16384", "parquet.page.row.count.limit": "200"})
    a = Analysis.from_store(spark, path, YEAR)
    one = a.filtered.where(F.col("CustomerId") == "c0123").select("OrderId")
    assert one.count() == n // 300
    assert _scan_rows(one) < n / 5
    missing = a.filtered.where(F.col("CustomerId") == "c0123x").select("OrderId")  # within the range, in no Bloom filter
    assert _scan_rows(missing) == 0


def test_lookup_that_fails_when_read_becomes_an_empty_one(spark, scratch):
    for name, df in _sources(spark).items():
        df.coalesce(1).write.parquet(f"{scratch}/{name}")
    (part,) = glob.glob(f"{scratch}/regions/*.parquet")
    data = bytearray(open(part, "rb").read())
    data[4:40] = b"\xff" * 36  # the footer is whole, the pages are not
    open(part, "wb").write(bytes(data))
    (part2,) = glob.glob(f"{scratch}/products/*.parquet")
    open(part2, "wb").write(b"no parquet at all")
    for crc in glob.glob(f"{scratch}/*/.*.crc"):
        os.remove(crc)
    raw = parquet_sources(spark, scratch)
    assert "regions" not in raw and "products" not in raw and "customers" in raw
    rows = Analysis(spark, PARAMS, raw=raw).fact.collect()
    assert rows and all(r.RegionName is None and r.ProductName is None for r in rows)
    assert scan_sources(spark, raw, PARAMS)["regions"].columns == ["RegionId", "RegionName"]
    (part3,) = glob.glob(f"{scratch}/order_lines/*.parquet")
    open(part3, "wb").write(b"no parquet at all")
    with pytest.raises(Exception):
        parquet_sources(spark, scratch)


def test_csv_dialect_keeps_every_value(spark, scratch):
    ddl = "a string, b double, c date, d timestamp_ntz, e bigint"
    texts = [None, "", " ", " a ", "a,b", 'say "x"', '"', "two\nlines", "\\", "\\\\N", "null", "é日本", "#x", "'"]
    rows = [(t, 0.1 * i, D(2001, 1, 1 + i), dt.datetime(2001, 1, 1, 1, 2, 3, i), i) for i, t in enumerate(texts)] + [(None,) * 5, (None, 1e300, None, None, -1)]
    df = spark.createDataFrame(rows, ddl).repartition(3)
    store.write_table(df, f"{scratch}/x", "csv", check=True)
    back = store.read_export(spark, f"{scratch}/x", df.schema, "csv")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    bad = spark.createDataFrame([("\\N", 1.0, None, None, 1)], ddl)
    with pytest.raises(ValueError, match="reads back"):
        store.write_table(bad, f"{scratch}/y", "csv", check=True)
    store.write_table(bad, f"{scratch}/z", "parquet", check=True)


def test_exact_sums(spark):
    from custlens.functions.numeric import exact_sum

    df = spark.createDataFrame([(0.1,)] * 10 + [(1e16,), (-1e16,), (None,)], "x double")
    assert df.agg(exact_sum(F.col("x"))).first()[0] == 1.0
    for values, want in (([None], None), ([], None), ([1e300, 1.0], 1e300), ([float("inf"), 1.0], float("inf"))):
        got = spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum(F.col("x"))).first()[0]
        assert got == want


def test_a_stored_fact_moves_wide_rows_once(spark, scratch, monkeypatch):
    """The shuffle that joins orders and customers to the lines clusters them by month too;
    an order held twice, in two months, and one without lines or packs keep their rows."""
    raw = _raw(spark)
    T = dt.datetime
    fields = raw["orders"].schema.fields
    twice = dict(SalesRepId="r", OrderStatus="packed", ShippingMethodRequested="G", CustomerId="c2", OrderId="1")
    more = [dict(twice, CreatedAt_order=T(2001, 4, 9)), dict(twice, CreatedAt_order=T(2001, 3, 9)), dict(twice, OrderId="none", CreatedAt_order=T(2001, 3, 9))]
    raw["orders"] = raw["orders"].unionByName(spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in more], raw["orders"].schema))
    raw["order_lines"] = raw["order_lines"].unionByName(raw["order_lines"].limit(1))
    want = Analysis(spark, PARAMS, raw=raw).fact
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in [*keys, store.CO_PARTITION]}
    plans = []
    listed = store._listed
    monkeypatch.setattr(store, "_listed", lambda *a: plans.append(spark.conf.get(store.CO_PARTITION)) or listed(*a))
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        clustered = Analysis(spark, PARAMS, raw=raw).fact_by_month
        spark.conf.set(store.CO_PARTITION, "false")
        from tests.helpers import plan_text
        wide = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\((\w+)#", plan_text(clustered))
        assert [k for columns, k in wide if "SalePrice" in columns and "CustomerName" in columns] == []
        assert wide and [k for columns, k in wide if "SalePrice" in columns][-1] == "OrderMonth"
        spark.conf.set(store.CO_PARTITION, before[store.CO_PARTITION])
        store.write_fact(clustered, f"{scratch}/clustered", PARAMS)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plans and set(plans) == {before[store.CO_PARTITION]}  # given back
    got = store.read_fact(spark, f"{scratch}/clustered")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))


def test_packs_of_other_lines_are_not_shuffled(spark, scratch):
    """Lines that have an order are stored before packs are attached; Spark filters the scan
    of the packs by their ids.  An analysis is written so, and nothing staged is left."""
    for name, df in _raw(spark).items():
        df.write.parquet(f"{scratch}/sources/{name}")
    raw = parquet_sources(spark, f"{scratch}/sources")
    raw["order_lines"] = raw["order_lines"].distinct()  # no plain scan, whose filter alone would do
    want = Analysis(spark, PARAMS, raw=raw).fact
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    from tests.helpers import plan_text
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        a = Analysis(spark, PARAMS, raw=raw)
        filters = [re.findall(r"might_contain\(.*?xxhash64\((.*)", plan_text(f))
                   for f in (a.fact_by_month, a.staged_fact(lambda df: store._stage(df, f"{scratch}/staged")))]
        assert ["PickedForOrderLine" in " ".join(f) for f in filters] == [False, True]
        assert "BroadcastExchange" in plan_text(a.fact_by_month)  # the shipping methods, whatever the threshold
        store.write_fact(a, f"{scratch}/fact", PARAMS)
        assert store.load_or_build(spark, f"{scratch}/built", lambda: a, PARAMS).count() == want.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = store.read_fact(spark, f"{scratch}/fact")
    assert got.count() and sorted(map(repr, got.collect())) == sorted(map(repr, want.select(got.columns).collect()))
    assert not glob.glob(f"{scratch}/fact/data/*/staged")
    (write,) = os.listdir(f"{scratch}/fact/data")
    assert sorted(os.listdir(f"{scratch}/fact/data/{write}")) == ["customers", "lines", "orders"]
    bare = Analysis(spark, PARAMS, fact=want)
    store.write_fact(bare, f"{scratch}/bare", PARAMS)
    assert store.read_fact(spark, f"{scratch}/bare").count() == want.count()
