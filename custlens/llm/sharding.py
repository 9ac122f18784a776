"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

``deal`` puts rows into shards whose row counts differ by at most one; every such
assignment, and every order inside a shard, is equally likely.

* Rows are stored once, so that their partitions are fixed (a lost executor or another
  number of cores can't change them); one number per partition, its row count, is known
  to all tasks.
* A shard's slots are cut into blocks of ``BLOCK_ROWS``.  The matrix says how many rows
  partition i sends to block j; given the row counts and block sizes it is multivariate
  hypergeometric.  Nobody holds the whole matrix: partitions form a binary tree, at each
  node the node's share of every block is split between the two halves by a draw seeded
  by the node, and a task walks from the root to its own partition, so all tasks agree.
* Each task permutes its rows and deals them to blocks by its row of the matrix; rows
  are exchanged by block; a second random order inside each block gives the slots.

No key takes part, so a key, a source or copies of a text that hold a third of all rows
are dealt like any others, and a block's task never exceeds ``BLOCK_ROWS`` rows.  The same
partitions and seed give the same result.

Results for special rows: nulls in any column, empty and long texts and repeated rows are
rows like others; a table without rows gives no rows; with fewer rows than shards the
first shards hold one each.  Input columns named ``shard`` or ``slot`` are replaced; any
other name is free.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from custlens.llm.common import written

SHARDS = 24
SEED = 12
# Rows of one task of the second permutation.
BLOCK_ROWS = 1 << 17
# numpy draws exactly below this many rows; above it rejection is used.
NUMPY_LIMIT = 10 ** 9


def shard_sizes(n_rows: int, shards: int) -> np.ndarray:
    """Rows per shard: at most one apart, the larger ones first."""
    return n_rows // shards + (np.arange(shards) < n_rows % shards).astype(np.int64)


def blocks(sizes: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, rows) of every block of the shards."""
    per = -(-sizes // block_rows)
    shard = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(shard)) - np.repeat(np.cumsum(per) - per, per)
    first = number * block_rows
    return shard, first, np.minimum(block_rows, sizes[shard] - first)


def _log_binomial(x: float, n: float, p: float) -> float:
    """log P(X = x), X binomial, by Loader's deviance form (accurate for huge n)."""
    if x == 0:
        return n * math.log1p(-p) if p < 1 else (0.0 if n == 0 else -math.inf)
    if x == n:
        return n * math.log(p)

    def rest(k: float) -> float:  # log k! less Stirling's formula
        if k < 16:
            return math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi)
        return (1 / 12 - (1 / 360 - 1 / 1260 / (k * k)) / (k * k)) / k

    def deviance(k: float, mean: float) -> float:  # k log(k / mean) + mean - k
        v = (k - mean) / (k + mean)
        if abs(v) > 0.1:
            return k * math.log(k / mean) + mean - k
        s, term, i = (k - mean) * v, 2 * k * v, 1
        while True:
            term *= v * v
            more = s + term / (2 * i + 1)
            if more == s:
                return s
            s, i = more, i + 1

    return (rest(n) - rest(x) - rest(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
            + 0.5 * math.log(n / (2 * math.pi * x * (n - x))))


def log_hypergeometric(k: int, good: int, bad: int, draws: int) -> float:
    """log of the chance of ``k`` good ones among ``draws``."""
    p = draws / (good + bad)
    return _log_binomial(k, good, p) + _log_binomial(draws - k, bad, p) - _log_binomial(draws, good + bad, p)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int, limit: int = NUMPY_LIMIT) -> int:
    """A hypergeometric number of any size: numpy's, or ratio-of-uniforms rejection."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < limit:
        return int(rng.hypergeometric(good, bad, draws))
    n, p = good + bad, good / (good + bad)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), low), high)
    spread = math.sqrt(draws * p * (1 - p) * (n - draws) / (n - 1) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    top = log_hypergeometric(mode, good, bad, draws)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(draws * p + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_hypergeometric(k, good, bad, draws) - top:
            return k


def multivariate(rng: np.random.Generator, colors: np.ndarray, draws: int, limit: int = NUMPY_LIMIT) -> np.ndarray:
    """How many of each color ``draws`` draws without replacement hit."""
    total = int(colors.sum())
    if total < limit or len(colors) == 1:
        if len(colors) == 1:
            return np.array([draws], np.int64)
        return rng.multivariate_hypergeometric(colors, draws, method="marginals")
    half = len(colors) // 2
    left = int(colors[:half].sum())
    hit = hypergeometric(rng, left, total - left, draws, limit)
    return np.concatenate([multivariate(rng, colors[:half], hit, limit), multivariate(rng, colors[half:], draws - hit, limit)])


def matrix_row(counts: np.ndarray, part: int, sizes: np.ndarray, seed: int, limit: int = NUMPY_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Row ``part`` of the communication matrix: (blocks, rows for each).

    ``counts`` are the rows of all partitions, ``sizes`` those of all blocks.
    """
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    low, high = 0, len(counts)
    at = np.flatnonzero(sizes)
    left = sizes[at].astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        drawn = multivariate(rng, left, int(before[mid] - before[low]), limit) if len(left) else left
        if part < mid:
            left, high = drawn, mid
        else:
            left, low = left - drawn, mid
        some = left > 0
        at, left = at[some], left[some]
    return at, left


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def deal(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard)."""
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    # The rows are packed, so that their column names never meet those of this function.
    row = F.struct(*[_column(c).alias(c) for c in kept], F.lit(0).alias("_")).alias("row")
    # monotonically_increasing_id: the partition's number above 33 bits of the row's place in it.
    fixed = written(rows.select(row, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")), "shard-rows")
    found = np.array(sorted(fixed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()), np.int64).reshape(-1, 2)
    parts, counts = found[:, 0], found[:, 1]
    shard_of, first_of, sizes = blocks(shard_sizes(int(counts.sum()), shards), block_rows)
    shared = rows.sparkSession.sparkContext.broadcast((parts, counts, sizes))  # one number per partition and per block

    def to_blocks(batches):
        parts, counts, sizes = shared.value
        known = (-1, None)
        for batch in batches:
            part = batch.column("part").to_numpy()
            place = batch.column("id").to_numpy() & ((1 << 33) - 1)
            block = np.zeros(len(part), np.int64)
            for p in np.unique(part):
                if known[0] != p:
                    nth = int(np.searchsorted(parts, p))
                    to, n = matrix_row(counts, nth, sizes, seed)
                    # The first permutation: which rows of the partition go to which block.
                    known = (p, np.random.default_rng([seed, len(counts) + 1, nth]).permutation(np.repeat(to, n)))
                here = part == p
                block[here] = known[1][place[here]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], names=["row", "part", "id", "block"])

    schema = StructType([*fixed.schema.fields, StructField("block", LongType())])
    dealt = fixed.mapInArrow(to_blocks, schema)
    # The second permutation: a random order of each block's rows.
    order = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "id"), "id")
    dealt = dealt.select("row", "block", (F.row_number().over(order) - 1).alias("place"))
    # Blocks are numbered shard by shard, so shard and slot are arithmetic on three runs at most.
    n_rows = int(counts.sum())
    large = n_rows % shards if shards else 0
    per_large, per_small = -(-(n_rows // shards + 1) // block_rows), -(-(n_rows // shards) // block_rows)
    edge = large * per_large
    small = F.col("block") - edge
    shard = F.when(F.col("block") < edge, F.floor(F.col("block") / max(per_large, 1))).otherwise(large + F.floor(small / max(per_small, 1)))
    number = F.when(F.col("block") < edge, F.col("block") % max(per_large, 1)).otherwise(small % max(per_small, 1))
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in kept], shard.cast("int").alias("shard"),
                        (number * block_rows + F.col("place")).cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> None:
    """The dealt rows as Parquet, a folder per shard; a file holds a run of slots in order."""
    dealt = deal(rows, shards, seed, block_rows)
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard per document.

    The law is ``rows``: shards hold equally many rows, at most one apart.  Only the
    narrow rows are exchanged; texts stay in their scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dealt = deal(narrow, shards, seed, block_rows)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
