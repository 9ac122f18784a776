"""Edge rows for the column helpers (FIXTURES.md §4)."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from custlens.functions import (
    clip_lower,
    elapsed_days,
    normalize_key,
    product_category,
    py_strip,
    rint2,
    safe_divide,
    to_date_tolerant,
    to_double,
    to_timestamp_tolerant,
)


def _col(spark, values, ddl):
    return spark.createDataFrame([(v,) for v in values], f"v {ddl}")


def test_py_strip_matches_python(spark):
    values = [" 12 ", "12\t", " 12 ", "\x1c12\x1f", "　12 ", None, "a b"]
    got = [r[0] for r in _col(spark, values, "string").select(py_strip(F.col("v"))).collect()]
    assert got == [None if v is None else v.strip() for v in values]


def test_normalize_key_integral_and_float(spark):
    ints = _col(spark, [3, None, 12], "bigint").select(normalize_key(F.col("v"), LongType())).collect()
    assert [r[0] for r in ints] == ["3", None, "12"]
    floats = _col(spark, [3.0, None, 2.5], "double").select(normalize_key(F.col("v"), DoubleType())).collect()
    assert [r[0] for r in floats] == ["3", None, "2.5"]
    strs = _col(spark, [" 12 ", "x"], "string").select(normalize_key(F.col("v"), StringType())).collect()
    assert [r[0] for r in strs] == ["12", "x"]


def test_to_double_tolerant(spark):
    values = ["1e3", " 12 ", "NaN", "inf", "1d", "abc", "1,000", None, "-2.5"]
    got = [r[0] for r in _col(spark, values, "string").select(to_double(F.col("v"), StringType())).collect()]
    assert got[0] == 1000.0 and got[1] == 12.0 and got[2] == 0.0 and math.isinf(got[3])
    assert got[4:8] == [0.0, 0.0, 0.0, 0.0] and got[8] == -2.5
    nums = _col(spark, [float("nan"), None, 1.5], "double").select(to_double(F.col("v"), DoubleType())).collect()
    assert [r[0] for r in nums] == [0.0, 0.0, 1.5]


def test_timestamp_parse_tolerant(spark):
    values = ["2001-02-03 04:05:06", "bad", "2001-13-01", None]
    df = _col(spark, values, "string")
    got = [r[0] for r in df.select(to_timestamp_tolerant(F.col("v"), StringType())).collect()]
    assert got == [dt.datetime(2001, 2, 3, 4, 5, 6), None, None, None]
    days = [r[0] for r in df.select(to_date_tolerant(F.col("v"), StringType())).collect()]
    assert days == [dt.date(2001, 2, 3), None, None, None]


@pytest.mark.parametrize("x", [0.125, 0.375, 1.005, 2.675, -0.125, 12345.675, 0.0])
def test_rint2_matches_numpy_round(spark, x):
    got = spark.range(1).select(rint2(F.lit(x)).alias("r")).first()["r"]
    assert got == float(np.round(x, 2))


def test_clip_keeps_null_and_safe_divide(spark):
    df = spark.createDataFrame([(-3, 0.0), (None, 2.0), (5, None)], "a int, b double")
    got = df.select(clip_lower(F.col("a"), 0).alias("c"), safe_divide(F.lit(1.0), F.col("b")).alias("d")).collect()
    assert [r["c"] for r in got] == [0, None, 5]
    assert [r["d"] for r in got] == [None, 0.5, None]


def test_elapsed_days_is_whole_elapsed_days(spark):
    rows = [
        (dt.datetime(2001, 1, 1, 23), dt.datetime(2001, 1, 2, 1)),  # 2 hours -> 0
        (dt.datetime(2001, 1, 1, 1), dt.datetime(2001, 1, 3, 0)),   # 47 hours -> 1
        (dt.datetime(2001, 1, 5), dt.datetime(2001, 1, 1)),          # negative
        (None, dt.datetime(2001, 1, 1)),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(clip_lower(elapsed_days(F.col("a"), F.col("b")), 0)).collect()]
    assert got == [0, 1, 0, None]


def test_product_category(spark):
    values = ["Beef – Ribeye", "Pork – Loin – Chop", "Lamb - Leg", None, "Plain"]
    got = [r[0] for r in _col(spark, values, "string").select(product_category(F.col("v"))).collect()]
    assert got == ["Beef", "Pork", "Lamb - Leg", None, "Plain"]


def test_rint2_and_strip_parity_on_many_values(spark):
    rng = np.random.default_rng(5)
    xs = np.concatenate([rng.normal(0, 1e4, 3000), rng.integers(-10**6, 10**6, 1000) / 1000.0 + 0.005])
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    got = [r[0] for r in df.select(rint2(F.col("v"))).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]
    ws = [" ", "\t", "\n", " ", " ", "　", "\x1f", "\u0085", "x", "y z"]
    texts = ["".join(rng.choice(ws, size=int(rng.integers(0, 6)))) for _ in range(2000)]
    sdf = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in sdf.select(py_strip(F.col("v"))).collect()] == [t.strip() for t in texts]
