"""Exact centroid clustering of integer vectors by Shallot search.

Lloyd's rounds with exact integer arithmetic: every vector goes to the nearest centroid
(squared Euclidean distance, ties to the smaller number), every non-empty centroid
becomes the componentwise ``floor(sum / count)`` of its vectors.

A vector remembers its nearest and second-nearest centroid, an upper bound on the
distance to the first and a lower bound on all others.  In a round

1. bounds are moved by what the centroids moved; a vector whose upper bound is below its
   lower bound, or below half the distance from its centroid to the next, is done;
2. otherwise the distances to both remembered centroids are computed, and the search
   starts from the closer one;
3. that centroid's neighbours, sorted by distance, are scanned while they lie within a
   ball of radius (distance to the start + distance to the second-nearest so far); the
   ball shrinks with every closer find;
4. survivors are compared by their exact integer squared distances.

Bounds are floats widened by more than their rounding, and skip only what is strictly
farther, so the result equals that of comparing all centroids.

Vectors stay in their partitions: a round is one pass that writes assignments and bounds
beside the vectors and one that sums them, exactly, per task and then per cluster; only
k rows reach the driver, whatever the input.  A round's table replaces the one before.

Results for special rows: a vector that is null, has another length, or holds a null or
non-finite component takes no part and has no row; components beyond +-2^27 after scaling
count as that bound, so that squared distances fit a long; equal vectors are assigned
alike; a null id hashes as the empty string; ids keep their type and may repeat; with
fewer vectors than ``k`` each is a first centroid; a table without vectors gives no rows;
further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StructField, StructType)

from custlens.llm.common import discard, written

DIM = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = 2
LARGEST = 1 << 27
# Relative widening of float bounds; their rounding is below 1e-12.
SLACK = 1e-9
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the kept vectors' components as integers floor(scale * x)."""
    e = F.col("embedding")

    def finite(x):
        return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))

    def integer(x):
        return F.least(F.greatest(F.floor(x.cast("double") * float(scale)), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")

    kept = vectors.where((F.size(e) == dim) & F.forall(e, finite))
    return kept.select("vec_id", F.transform(e, integer).alias("q"))


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<vec_id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(key, "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances from points[i] to centroids[which[i]]."""
    away = points - centroids[which]
    return np.einsum("ij,ij->i", away, away)


class Neighbours:
    """What the search needs of the centroids: their distances and sorted neighbours."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        k = len(centroids)
        apart = np.zeros((k, k))
        for j in range(k):
            apart[j] = np.sqrt(squared(centroids, centroids, np.full(k, j)).astype(np.float64))
        others = apart + np.diag(np.full(k, -1.0))  # itself first
        self.order = np.argsort(others, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.half = self.apart[:, 1] / 2 if k > 1 else np.full(k, np.inf)


def search(points: np.ndarray, near: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray,
           space: Neighbours) -> int:
    """Moves near, second, upper and lower (in place) to the exact nearest centroids.

    Returns the number of distances computed.
    """
    c = space.centroids
    k = len(c)
    if k == 1:
        near[:], second[:], upper[:], lower[:] = 0, 0, np.inf, np.inf
        return 0
    bound = np.maximum(lower, space.half[near] * (1 - SLACK))
    at = np.flatnonzero(~(upper < bound))
    if not len(at):
        return 0
    best = squared(points[at], c, near[at])
    computed = len(at)
    upper[at] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    open_ = ~(upper[at] < bound[at])
    at, best = at[open_], best[open_]
    if not len(at):
        return computed
    x, a, b = points[at], near[at].copy(), second[at].copy()
    other = squared(x, c, b)
    computed += len(at)
    swap = (other < best) | ((other == best) & (b < a))
    a[swap], b[swap] = b[swap], a[swap].copy()
    best[swap], other[swap] = other[swap], best[swap].copy()
    start, skip = a.copy(), b.copy()
    reach = np.sqrt(best.astype(np.float64))
    live = np.arange(len(at))
    for t in range(1, k):
        ball = (reach[live] + np.sqrt(other[live].astype(np.float64))) * (1 + SLACK)
        live = live[~(space.apart[start[live], t] > ball)]
        if not len(live):
            break
        j = space.order[start[live], t]
        new = j != skip[live]
        i, j = live[new], j[new]
        d = squared(x[i], c, j)
        computed += len(i)
        first = (d < best[i]) | ((d == best[i]) & (j < a[i]))
        f, g = i[first], i[~first]
        b[f], other[f] = a[f], best[f]
        a[f], best[f] = j[first], d[first]
        closer = d[~first] < other[g]
        b[g[closer]], other[g[closer]] = j[~first][closer], d[~first][closer]
    near[at], second[at] = a, b
    upper[at] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
    lower[at] = np.sqrt(other.astype(np.float64)) * (1 - SLACK)
    return computed


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = pc.list_flatten(batch.column("q")).to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(batch.num_rows, -1)


_STATE = [StructField("q", ArrayType(IntegerType())), StructField("near", IntegerType()), StructField("second", IntegerType()),
          StructField("upper", DoubleType()), StructField("lower", DoubleType()), StructField("distance", LongType())]


def assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Every vector's nearest centroids after the centroids moved by ``moved`` (distances
    per centroid); None for the first assignment, where nothing is known yet."""
    shared = state.sparkSession.sparkContext.broadcast((centroids, moved))  # k vectors

    def run(batches):
        centroids, moved = shared.value
        space = Neighbours(centroids)
        for batch in batches:
            x = _matrix(batch)
            n = len(x)
            if moved is None:
                near, second = np.zeros(n, np.int64), np.full(n, min(1, len(centroids) - 1), np.int64)
                upper, lower = np.full(n, np.inf), np.zeros(n)
            else:
                near, second, upper, lower = (batch.column(c).to_numpy().copy() for c in ("near", "second", "upper", "lower"))
                near, second = near.astype(np.int64), second.astype(np.int64)
                upper = (upper + moved[near]) * (1 + SLACK)
                # The farthest that any other centroid came closer.
                far = np.argsort(moved)
                most = np.where(near == far[-1], moved[far[-2]] if len(far) > 1 else 0.0, moved[far[-1]])
                lower = (lower - most) * (1 - SLACK)
            search(x, near, second, upper, lower, space)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.array(near.astype(np.int32)), pa.array(second.astype(np.int32)),
                 pa.array(upper), pa.array(lower), pa.array(squared(x, centroids, near))],
                names=["vec_id", "q", "near", "second", "upper", "lower", "distance"])

    return state.mapInArrow(run, StructType([state.schema["vec_id"], *_STATE]))


def sums(state: DataFrame, k: int, dim: int = DIM) -> list[tuple[int, int, list[int]]]:
    """(cluster, count, componentwise sums) of every non-empty cluster: k rows."""

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            x, near = _matrix(batch), batch.column("near").to_numpy()
            order = np.argsort(near, kind="stable")
            cluster, first = np.unique(near[order], return_index=True)
            total[cluster] += np.add.reduceat(x[order], first, axis=0) if len(first) else 0
            count += np.bincount(near, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))],
            names=["cluster", "n", "total"])

    partial = state.select("q", "near").mapInArrow(run, "cluster int, n long, total array<long>")
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    rows = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()
    return [(r["cluster"], r["n"], [int(r[f"s{i}"]) for i in range(dim)]) for r in rows]


def _moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    away = (after - before).astype(np.float64)
    return np.sqrt((away * away).sum(axis=1)) * (1 + SLACK)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per kept vector.

    ``distance`` is the squared distance to the final centroid; inertias are its sums over
    the cluster and over all; the digest is of the final centroid's components, as decimal
    integers joined by commas.
    """
    spark = vectors.sparkSession
    state = written(integer_vectors(vectors, dim, scale), "vectors")
    centroids = first_centroids(state, k, seed)
    out = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return state.select("vec_id", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in out.split(", ")])
    moved = None
    for r in range(rounds + 1):
        after = written(assign(state, centroids, moved), f"clusters-{r}")
        discard(state)
        state = after
        if r == rounds:
            break
        new = centroids.copy()
        for j, n, total in sums(state, len(centroids), dim):
            new[j] = [s // n for s in total]  # floor, also below zero
        moved, centroids = _moved(centroids, new), new
    inertia = {r["near"]: int(r["d"]) for r in
               state.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(sum(inertia.values()), _LONG)
    facts = [(j, min(d, _LONG), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest())
             for j, d in inertia.items()]
    facts = spark.createDataFrame(facts, "near int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "near").select(  # k rows
        "vec_id", F.col("near").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The query's rows over ``embeddings`` in DuckDB SQL (all centroids compared)."""
    ctes = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale}::DOUBLE * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
            f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, q AS c FROM (
    SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, q FROM kept ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        ctes.append(f"""a{r} AS MATERIALIZED (
  SELECT row, min(d * {k} + j) AS m FROM (
    SELECT row, j, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY row)""")
        if r < rounds:
            ctes.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.j AS j, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT j, list((((s - ((s % n + n) % n)) // n)::BIGINT) ORDER BY i) AS c FROM (
      SELECT j, i, sum(x) AS s, count(*) AS n FROM (
        SELECT m % {k} AS j, unnest(q) AS x, unnest(range({dim})) AS i FROM kept JOIN a{r} USING (row)) GROUP BY j, i) GROUP BY j) n USING (j))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, (m % {k})::INT AS cluster, (m // {k})::BIGINT AS distance,
  sum(m // {k}) OVER (PARTITION BY m % {k})::BIGINT AS cluster_inertia, sum(m // {k}) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (row) JOIN c{rounds} ON j = m % {k}"""
