"""Every catalog query against its independent DuckDB SQL on the supplied tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from custlens.catalog import QUERIES
from tools.compare import digest, duck

SF_DIR = os.environ.get("CUSTLENS_TEST_SF", "/root/testdata/sf0.001")
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_oracle_sql():
    assert set(QUERIES) <= set(E.oracle_sql())
    assert set(QUERIES) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["CustomerName", "RegionName", "Revenue", "Orders", "RetentionRate"]
    assert len(df.collect()) == 10


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    sdf = E.queries()[key](spark, SF_DIR)
    got = digest(sdf.columns, [tuple(r) for r in sdf.collect()])
    cur = con.execute(E.oracle_sql()[key])
    want = digest([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0], "columns differ"
    assert got[1] == want[1], "row counts differ"
    if got[2] != want[2]:
        extra = sorted(set(got[3]) - set(want[3]))[:3]
        missing = sorted(set(want[3]) - set(got[3]))[:3]
        pytest.fail(f"values differ; spark-only {extra}; oracle-only {missing}")
