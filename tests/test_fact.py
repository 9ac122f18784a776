"""Fact build (J1-J9, A1, P1-P15) on hand-made source tables."""

from __future__ import annotations

import datetime as dt

import pytest

from custlens.config import Params
from custlens.operators.fact import build_fact
from custlens.schemas import SCAN_COLUMNS, SOURCE_SCHEMAS
from custlens.sources.scans import scan_sources
from custlens.sources.store import read_fact, write_fact
from tests.helpers import plan_text

T = dt.datetime
PARAMS = Params(fetch_start=dt.date(2001, 1, 1), fetch_end=dt.date(2001, 12, 31),
                start=dt.date(2001, 1, 1), end=dt.date(2001, 12, 31), as_of=dt.date(2002, 1, 1),
                packed_status="packed")


def _df(spark, name, rows):
    schema = SOURCE_SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def _sources(spark, packs=None, drop=()):
    orders = [
        dict(OrderId=" 1 ", CustomerId="c1", SalesRepId="r", OrderStatus="packed",
             CreatedAt_order=T(2001, 3, 1, 9), DateOrdered=T(2001, 3, 1), DateExpected=T(2001, 3, 10),
             ShipDate=T(2001, 3, 2, 23), ShippingMethodRequested="G"),
        dict(OrderId="2", CustomerId="c9", SalesRepId="r", OrderStatus="packed",
             CreatedAt_order=T(2001, 4, 1, 9), DateOrdered=T(2001, 4, 1), DateExpected=None,
             ShipDate=T(2001, 4, 2), ShippingMethodRequested="X"),
        dict(OrderId="3", CustomerId="c1", SalesRepId="r", OrderStatus="open",
             CreatedAt_order=T(2001, 4, 1, 9), ShippingMethodRequested="G"),
    ]
    lines = [
        dict(OrderLineId="L1", OrderId="1", ProductId="p3", ShipperId="s1", QuantityShipped=1.0,
             SalePrice=10.0, UnitCost=4.0, CreatedAt=T(2001, 3, 1)),
        dict(OrderLineId="L2", OrderId="1", ProductId="p1", ShipperId="s1", QuantityShipped=1.0,
             SalePrice=10.0, UnitCost=4.0, CreatedAt=T(2001, 3, 1)),
        dict(OrderLineId="L3", OrderId="2", ProductId="pX", ShipperId="s1", QuantityShipped=1.0,
             SalePrice=5.0, UnitCost=1.0, CreatedAt=T(2001, 4, 1)),
        dict(OrderLineId="L4", OrderId="3", ProductId="p1", ShipperId="s1", QuantityShipped=1.0,
             SalePrice=5.0, UnitCost=1.0, CreatedAt=T(2001, 4, 1)),
    ]
    if packs is None:
        packs = [
            dict(PickedForOrderLine="L1", WeightLb=2.0, ItemCount=1.0, DeliveryDate=T(2001, 3, 3, 1)),
            dict(PickedForOrderLine="L1 ", WeightLb=3.0, ItemCount=2.0, DeliveryDate=T(2001, 3, 5)),
            dict(PickedForOrderLine="L2", WeightLb=None, ItemCount=4.0, DeliveryDate=T(2001, 3, 1)),
        ]
    raw = {
        "orders": _df(spark, "orders", orders),
        "order_lines": _df(spark, "order_lines", lines),
        "customers": _df(spark, "customers", [
            dict(CustomerId="c1", CustomerName="Alpha", RegionId="1", Address1="  7 Elm ", City="X")]),
        "products": _df(spark, "products", [
            dict(ProductId="p3", UnitOfBillingId="3", SupplierId="9", ProductName="Beef – Rib"),
            dict(ProductId="p1", UnitOfBillingId=None, SupplierId="9", ProductName="Pork"),
        ]),
        "regions": _df(spark, "regions", [dict(RegionId="1", RegionName="EAST")]),
        "shippers": _df(spark, "shippers", [dict(ShipperId="s1", Carrier="Fast"), dict(ShipperId="s1", Carrier="Dup")]),
        "shipping_methods": _df(spark, "shipping_methods", [dict(SMId="G", ShippingMethodName="GROUND")]),
        "suppliers": _df(spark, "suppliers", [dict(SupplierId="9", SupplierName="Sup")]),
        "packs": _df(spark, "packs", packs),
    }
    for name in drop:
        raw.pop(name)
    return raw


def _fact(spark, **kw):
    raw = _sources(spark, **kw)
    return build_fact(scan_sources(spark, raw, PARAMS), PARAMS)


def test_fact_rows_measures_and_fanout(spark):
    rows = {(r.OrderLineId, r.Carrier): r for r in _fact(spark).collect()}
    # status filter drops order 3; duplicate shipper key fans out every line x2
    assert sorted(k[0] for k in rows) == ["L1", "L1", "L2", "L2", "L3", "L3"]
    l1 = rows[("L1", "Fast")]
    # two packs summed (keys stripped), latest delivery; unit '3' bills by weight
    assert (l1.WeightLb, l1.ItemCount, l1.Revenue, l1.Cost, l1.Profit) == (5.0, 3.0, 50.0, 20.0, 30.0)
    assert l1.DeliveryDate == T(2001, 3, 5) and l1.TransitDays == 2 and l1.DeliveryStatus == "On Time"
    assert l1.Address1 == "7 Elm" and l1.RegionName == "EAST" and l1.SupplierName == "Sup"
    assert l1.ShippingMethodName == "GROUND" and l1.Date == dt.date(2001, 3, 1)
    l2 = rows[("L2", "Fast")]
    # all-null weights sum to 0; null billing unit bills by item count;
    # delivery before shipping clips to 0
    assert (l2.WeightLb, l2.ItemCount, l2.Revenue) == (0.0, 4.0, 40.0)
    assert l2.TransitDays == 0
    l3 = rows[("L3", "Fast")]
    # no pack: zero weight/items, null delivery -> null transit and Late;
    # unknown customer/product/method -> null lookups
    assert (l3.WeightLb, l3.ItemCount, l3.Revenue) == (0.0, 0.0, 0.0)
    assert l3.DeliveryDate is None and l3.TransitDays is None and l3.DeliveryStatus == "Late"
    assert l3.CustomerName is None and l3.ProductName is None and l3.ShippingMethodName is None


def test_empty_packs_and_missing_lookup(spark):
    fact = _fact(spark, packs=[], drop=("regions",))
    rows = fact.collect()
    assert all(r.WeightLb == 0.0 and r.ItemCount == 0.0 and r.DeliveryDate is None for r in rows)
    assert all(r.RegionName is None for r in rows)
    assert "RegionName" in fact.columns


def test_missing_fact_source_or_key_raises(spark):
    raw = _sources(spark, drop=("orders",))
    with pytest.raises(KeyError):
        scan_sources(spark, raw, PARAMS)
    raw = _sources(spark)
    scanned = scan_sources(spark, raw, PARAMS)
    scanned["orders"] = scanned["orders"].drop("SalesRepId")
    with pytest.raises(KeyError):
        build_fact(scanned, PARAMS)


def test_no_order_lines_raises(spark):
    raw = _sources(spark)
    scanned = scan_sources(spark, raw, PARAMS.replace(fetch_start=dt.date(1990, 1, 1), fetch_end=dt.date(1990, 2, 1)))
    with pytest.raises(RuntimeError):
        build_fact(scanned, PARAMS)


def test_fetch_end_is_midnight(spark):
    raw = _sources(spark)
    # orders created 2001-03-01 09:00 are excluded by an end bound of 2001-03-01
    scanned = scan_sources(spark, raw, PARAMS.replace(fetch_end=dt.date(2001, 3, 1)))
    assert scanned["orders"].count() == 0
    assert scanned["order_lines"].count() == 2


def test_fact_roundtrip_partitioned(spark, scratch):
    fact = _fact(spark)
    write_fact(fact, f"{scratch}/fact")
    back = read_fact(spark, f"{scratch}/fact")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, fact.collect()))
    pruned = read_fact(spark, f"{scratch}/fact", dt.date(2001, 4, 1), dt.date(2001, 4, 30))
    assert {r.OrderLineId for r in pruned.collect()} == {"L3"}
    plan = plan_text(pruned)
    assert "PartitionFilters: [isnotnull(OrderMonth" in plan


def test_scan_pushdown_into_parquet(spark, scratch):
    raw = _sources(spark)
    for name, df in raw.items():
        df.write.mode("overwrite").parquet(f"{scratch}/{name}")
    from custlens.sources.scans import parquet_sources

    scanned = scan_sources(spark, parquet_sources(spark, scratch), PARAMS)
    plan = plan_text(scanned["orders"])
    assert "EqualTo(OrderStatus,packed)" in plan
    assert "GreaterThanOrEqual(CreatedAt_order" in plan and "LessThanOrEqual(CreatedAt_order" in plan
    assert set(SCAN_COLUMNS["orders"]) == set(scanned["orders"].columns)


def test_parquet_sources_check_and_tolerate(spark, scratch):
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    from custlens.sources.scans import parquet_sources

    raw = _sources(spark, drop=("suppliers",))
    for name, df in raw.items():
        if name == "orders":  # numeric keys and times as text
            df = df.withColumns({"OrderId": F.trim("OrderId").cast("bigint"), "ShipDate": F.col("ShipDate").cast("string")})
        if name == "order_lines":
            df = df.withColumns({"OrderId": F.col("OrderId").cast("double"), "SalePrice": F.col("SalePrice").cast("string")})
        if name == "customers":
            df = df.drop("Phone")
        df.write.parquet(f"{scratch}/s/{name}")
    for root in (f"{scratch}/s", f"file:{scratch}/s"):  # whatever the scheme, Spark finds the tables
        sources = parquet_sources(spark, root)
        assert set(sources) == set(raw)
    got = build_fact(scan_sources(spark, sources, PARAMS), PARAMS).drop("Phone", "SupplierName")
    want = _fact(spark, drop=("suppliers",)).drop("Phone", "SupplierName")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    raw["orders"].drop("CustomerId").write.parquet(f"{scratch}/t/orders")
    raw["order_lines"].write.parquet(f"{scratch}/t/order_lines")
    with pytest.raises(KeyError, match="CustomerId"):
        parquet_sources(spark, f"{scratch}/t")
    with pytest.raises(AnalysisException):
        parquet_sources(spark, f"{scratch}/nothing")


def test_odd_number_keys(spark):
    from pyspark.sql import functions as F

    from custlens.functions.text import normalize_key

    df = spark.createDataFrame([(3.0,), (2.5,), (float("nan"),), (1e30,), (None,), (float("inf"),)], "k double")
    got = [r[0] for r in df.select(normalize_key(F.col("k"), df.schema["k"].dataType)).collect()]
    assert got[:3] == ["3", "2.5", None] and got[4] is None and got[3] is not None and got[3] != "9223372036854775807"


def test_regions_without_a_row_and_lines_without_packs(spark):
    rows = _fact(spark, drop=("regions",)).collect()
    assert rows and all(r.RegionName is None for r in rows)
    assert any(r.WeightLb == 0.0 and r.DeliveryDate is None for r in rows)


def test_checkpoint_folder_must_be_shared_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from custlens.config import ensure_checkpoint_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077",
                              getConf=lambda: SimpleNamespace(get=lambda k, d=None: d))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_drilldown_of_a_name_shared_by_two_ids(spark):
    import datetime as dt

    from custlens.operators.customers import customer_aggregates
    from custlens.plans import customer_drilldown
    from tests.helpers import report_rows

    df = report_rows(spark, [
        dict(CustomerId="1", CustomerName="Twin", OrderId="a", Revenue=10.0, ProductName="Pork – Leg"),
        dict(CustomerId="2", CustomerName="Twin", OrderId="b", Revenue=90.0, Date=dt.date(2001, 1, 5)),
        dict(CustomerId="2", CustomerName="Twin", OrderId="c", Revenue=20.0, Date=dt.date(2001, 3, 5)),
        dict(CustomerId="3", CustomerName="Other", OrderId="d", Revenue=500.0),
    ])
    out = customer_drilldown(df, customer_aggregates(df, dt.date(2002, 1, 1)), ["Twin"])
    assert [r.CustomerId for r in out["profile"].collect()] == ["2"]
    assert [(r.CustomerId, r.MonthlyRevenue) for r in out["monthly_history"].collect()] == [("2", 90.0), ("2", 0.0), ("2", 20.0)]
    assert [(r.CustomerId, r.ProductCategory, r.Spend) for r in out["category_mix"].collect()] == [("2", "Beef", 110.0)]


def test_customer_attributes_come_from_one_row(spark):
    import datetime as dt

    from custlens.operators.customers import customer_aggregates
    from tests.helpers import report_rows

    df = report_rows(spark, [
        dict(CustomerId="1", CustomerName="Beta", City="Aton", OrderId="a"),
        dict(CustomerId="1", CustomerName="Alpha", City="Zed", OrderId="b"),
    ])
    r = customer_aggregates(df, dt.date(2002, 1, 1)).first()
    assert (r.CustomerName, r.City) == ("Alpha", "Zed")


def test_cent_prices_agree_with_decimals(spark):
    """Sums of cents differ from exact decimal sums by rounding only."""
    import datetime as dt
    from decimal import Decimal

    from custlens.operators.customers import customer_aggregates
    from tests.helpers import report_rows

    cents = [(i * 7919) % 100_000 for i in range(1, 400)]
    df = report_rows(spark, [dict(OrderId=f"o{i}", Revenue=c / 100, Cost=c / 300) for i, c in enumerate(cents)])
    total = customer_aggregates(df.repartition(7), dt.date(2002, 1, 1)).first().TotalRevenue
    assert abs(total - float(sum(Decimal(c) / 100 for c in cents))) < 1e-6


def test_lines_are_looked_for_among_few_orders_first(spark):
    from pyspark.sql import functions as F

    from custlens.operators.fact import has_lines

    few = F.pmod(F.xxhash64("OrderId"), F.lit(1024)) == 0
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("OrderId"))
    inside, outside = ids.where(few), ids.where(~few)
    assert has_lines(inside) and has_lines(outside) and has_lines(ids)
    assert has_lines(spark.createDataFrame([(None,)], "OrderId string"))
    assert not has_lines(ids.limit(0))


def test_lines_without_an_order_are_dropped_at_the_scan(spark):
    from custlens.config import RUNTIME_FILTERS, use_runtime_filters

    _fact(spark)
    assert all(spark.conf.get(k) is not None for k in RUNTIME_FILTERS)
    key, value = next(iter(RUNTIME_FILTERS.items()))
    spark.conf.set(key, "5g")
    try:
        use_runtime_filters(spark)
        assert spark.conf.get(key) in ("5g", str(5 * 2 ** 30), f"{5 * 2 ** 30}b")  # the session's own value stays
    finally:
        spark.conf.set(key, value)


def test_exact_sum_makes_no_decimal_of_a_small_amount(spark):
    import decimal

    from pyspark.sql import functions as F

    from custlens.functions.numeric import exact_sum

    rows = [(g, s * v) for g, vs in enumerate([[0.1] * 7, [8.9e6] * 3000, [9e6, 0.1, 1e-9], [-1e16, 0.5], [1e300, 1.5], [None]])
            for s in (1, -1, -1) for v in vs if v is not None] + [(5, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(3)
    got = {r.g: r.t for r in df.groupBy("g").agg(exact_sum(F.col("x")).alias("t")).collect()}
    for g in range(4):
        units = sum(decimal.Decimal(repr(x)) * 10 ** 9 for k, x in rows if k == g)
        assert got[g] == float(units) / 1e9
    assert got[4] == -1e300 and got[5] is None
    plan = plan_text(df.groupBy("g").agg(exact_sum(F.col("x")).alias("t")))
    assert "sum(cast((" in plan or "as bigint" in plan
