"""Clustering against comparison with all centroids, in plain integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from custlens.llm import clustering as cl
from custlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import SF, duck_sf_matches

DDL = "vec_id long, embedding array<float>, label int"


def plain(rows, k, rounds, dim, seed=cl.SEED):
    """Lloyd's rounds over (vec_id, vector), every vector against every centroid."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept]
    order = sorted(range(len(kept)), key=lambda n: (digest[n], kept[n][1]))
    c = [list(kept[n][1]) for n in order[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        near = [nearest(q)[1] for _, q in kept]
        for j in range(len(c)):
            mine = [q for (_, q), n in zip(kept, near) if n == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [nearest(q) for _, q in kept]
    total = sum(d for d, _ in last)
    return sorted((str(i), j, d, sum(e for e, m in last if m == j), total,
                   hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last))


def result(df):
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in df.collect())


def test_equals_sql_on_supplied_vectors(spark):
    duck_sf_matches(QUERIES["op11_clustering"](spark, SF), ORACLE_SQL["op11_clustering"], "embeddings")


@pytest.mark.parametrize("k", [1, 2, 3, 7, 200])
def test_equals_plain_rounds_with_ties_and_odd_rows(spark, k):
    rng = np.random.default_rng(k)
    # Few distinct values: many equal distances and equal vectors.
    rows = [(i, [float(x) / 256 for x in rng.integers(-3, 4, 4)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, [0.1] * 4), (None, [0.5] * 4), (900, None), (901, [1.0] * 3), (902, [1.0, None, 1.0, 1.0]),
             (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], DDL).repartition(5)
    floats = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert result(cl.cluster(df, k=k, rounds=4, dim=4)) == plain(floats, k, 4, 4)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2), (2, [0.0] * 3, 2)]):
        out = cl.cluster(spark.createDataFrame(rows, DDL))
        assert out.collect() == [] and "centroid_sha256" in out.columns


def test_clashing_columns_string_ids_and_huge_components(spark):
    df = spark.createDataFrame([("a", [3e30, -3e30], 1, 2, 3), ("b", [0.0, 0.0], 1, 2, 3)],
                               "vec_id string, embedding array<double>, q int, near int, cluster int")
    out = {r["vec_id"]: r for r in cl.cluster(df, k=2, dim=2).collect()}
    assert set(out) == {"a", "b"} and out["a"]["distance"] == 0 and out["a"]["cluster"] != out["b"]["cluster"]


def test_search_computes_fewer_distances_and_the_same_result():
    rng = np.random.default_rng(1)
    means = rng.integers(-2000, 2000, (30, 8))
    points = means[rng.integers(0, 30, 2000)] + rng.integers(-60, 60, (2000, 8))
    centroids = points[:30].copy()
    near, second = np.zeros(2000, np.int64), np.ones(2000, np.int64)
    upper, lower = np.full(2000, np.inf), np.zeros(2000)
    computed = 0
    for _ in range(5):
        space = cl.Neighbours(centroids)
        computed += cl.search(points, near, second, upper, lower, space)
        every = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (near == every.argmin(axis=1)).all()
        exact = np.sqrt(every[np.arange(2000), near])
        others = every.copy()
        others[np.arange(2000), near] = np.iinfo(np.int64).max
        assert (upper >= exact).all() and (lower <= np.sqrt(others.min(axis=1))).all()
        new = np.array([points[near == j].sum(axis=0) // max(1, (near == j).sum()) if (near == j).any() else centroids[j] for j in range(30)])
        moved = cl._moved(centroids, new)
        upper = (upper + moved[near]) * (1 + cl.SLACK)
        lower = (lower - moved.max()) * (1 - cl.SLACK)
        centroids = new
    assert computed < 0.4 * 5 * 2000 * 30
