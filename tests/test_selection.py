"""Keys at ranks by histograms, against sorting."""

from __future__ import annotations

import math
import random
import sys

import pytest

from custlens.operators import selection as sel

def order():
    return [*sel.descending("f"), *sel.descending("m"), *sel.ascending_text("id")]


KINDS = ["double", "int", "double", "int", "int", "text"]


def plain(rows):
    def down(x):
        most = sys.float_info.max
        if x is None:
            return most, 4
        if math.isnan(x):
            return -most, 0
        if math.isinf(x):
            return (-most, 1) if x > 0 else (most, 3)
        return 0.0 - x, 2

    def key(r):
        i, f, m = r
        return (*down(None if f is None else float(f)), *down(m), int(i is None), i or "")

    return sorted(map(key, rows), key=lambda k: (*k[:5], k[5].encode()))


def check(spark, rows, ranks):
    df = spark.createDataFrame(rows, "id string, f long, m double").repartition(3)
    want = plain(rows)
    got = sel.keys_at_ranks(df, [order(), order()[2:]], [KINDS, KINDS[2:]], [ranks, ranks])
    assert got[0] == [want[r - 1] for r in ranks]
    short = sorted((w[2:] for w in want), key=lambda k: (*k[:3], k[3].encode()))
    assert got[1] == [short[r - 1] for r in ranks]
    for key in got[0]:
        assert df.where(sel.at_or_before(order(), key)).count() == want.index(key) + 1


@pytest.mark.parametrize("few", [1, 1024])
def test_odd_values_and_ties(spark, monkeypatch, few):
    monkeypatch.setattr(sel, "FEW", few)
    rng = random.Random(few)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 5e-324, 1e-323, 1.7e308, -1.7e308, 1.0, 1.0 + 2 ** -52, 0.1]
    rows = [(f"c{i}", rng.choice([None, 0, 1, 1, 1, 7, 10 ** 12]), rng.choice(odd)) for i in range(150)]
    rows += [(None, 1, 0.1), ("", 1, 0.1), ("é", 1, 0.1), ("日本", 1, 0.1), ("c", 1, 0.1), ("c1 ", 1, 0.1)]
    n = len(rows)
    check(spark, rows, [1, n // 4, n // 2, 3 * n // 4, n])


def test_one_value_holds_nearly_all_rows(spark, monkeypatch):
    monkeypatch.setattr(sel, "FEW", 10)
    rows = [(f"{i:05d}", 1, 5.0) for i in range(900)] + [(f"x{i}", 2, float(i)) for i in range(40)]
    check(spark, rows, [20, 300, 470, 700])


def test_passes_are_few_and_small(spark, monkeypatch):
    passes = []
    real = sel._pass
    monkeypatch.setattr(sel, "_pass", lambda *a: passes.append(len(a[1])) or real(*a))
    rng = random.Random(5)
    rows = [(str(i), rng.randrange(30), rng.lognormvariate(5, 2)) for i in range(20_000)]
    check(spark, rows, [5_000, 10_000, 15_000])
    assert len(passes) <= 6
