"""One customer (and one region) holding a third of all lines: results must stay
whole and exact, and the plans must combine that key before any shuffle."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from custlens import plans as P
from custlens.operators.customers import customer_aggregates
from custlens.operators.ordering import global_rank
from tests.helpers import plan_text, report_rows

AS_OF = dt.date(2001, 8, 2)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    hot = n // 3
    rows = []
    for i in range(n):
        cust = "HOT" if i < hot else f"c{rng.integers(0, 400):03d}"
        region = "EAST" if cust == "HOT" or i % 2 else f"R{i % 5}"
        rows.append(dict(
            CustomerId=cust, CustomerName=f"N-{cust}", RegionName=region,
            OrderId=f"o{rng.integers(0, 900)}-{cust}", Revenue=float(rng.integers(1, 900)),
            Cost=float(rng.integers(0, 500)), WeightLb=float(rng.integers(0, 20)),
            Date=dt.date(2000, 1, 1) + dt.timedelta(days=int(rng.integers(0, 500))),
        ))
    df = report_rows(spark, rows).repartition(8)
    return df, pd.DataFrame(rows)


def test_customer_aggregate_with_hot_customer(spark, skewed):
    df, pdf = skewed
    got = {r.CustomerId: r for r in customer_aggregates(df, AS_OF).collect()}
    exp = pdf.groupby("CustomerId").agg(rev=("Revenue", "sum"), orders=("OrderId", "nunique"),
                                        first=("Date", "min"), last=("Date", "max"))
    assert set(got) == set(exp.index)
    for cid, e in exp.iterrows():
        g = got[cid]
        assert (g.TotalRevenue, g.TotalOrders, g.FirstOrder, g.LastOrder) == (e.rev, e.orders, e["first"], e["last"])
    # line- and order-level aggregations are hash-based; the only sort-based
    # one is the customer-scale attribute table
    plan = plan_text(customer_aggregates(df, AS_OF)).split("\n\n")[0]
    assert plan.count("SortAggregate") <= 2 and plan.count("HashAggregate") >= 6


def test_new_vs_returning_with_hot_customer(spark, skewed):
    df, pdf = skewed
    first = pdf.groupby("CustomerId")["Date"].transform("min")
    exp_new = pdf.loc[pdf["Date"] == first, "Revenue"].sum()
    got = {r.Type: r.Revenue for r in P.new_vs_returning(df).collect()}
    assert got["New Customer Revenue"] == exp_new
    assert got["Returning Customer Revenue"] == pdf["Revenue"].sum() - exp_new


def test_top_n_with_hot_region(spark, skewed):
    df, pdf = skewed
    top = {(r.RegionName, r.CustomerName): r.TotalRevenue for r in P.top_customers_per_region(df, 3).collect()}
    g = pdf.groupby(["RegionName", "CustomerName"], as_index=False)["Revenue"].sum()
    g = g.sort_values(["RegionName", "Revenue", "CustomerName"], ascending=[True, False, True])
    exp = {(r.RegionName, r.CustomerName): r.Revenue for r in g.groupby("RegionName").head(3).itertuples()}
    assert top == exp


def test_global_rank_with_hot_value(spark):
    # a third of the rows share one sort value; ties are broken by the unique key
    rows = [(f"k{i:05d}", 0.0 if i % 3 == 0 else float(i % 97)) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranked = global_rank(df, [F.desc("v"), F.asc("k")], rank_col="r", num_partitions=8)
    got = sorted((r.r, r.k) for r in ranked.collect())
    exp = sorted(rows, key=lambda t: (-t[1], t[0]))
    assert [k for _, k in got] == [k for k, _ in exp]
    sizes = [r["n"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < len(rows) / 2  # the hot value is spread over several partitions
