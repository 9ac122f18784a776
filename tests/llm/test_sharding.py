"""Exact shard sizes, gapless slots, uniform dealing, and the draws behind them."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from custlens.llm import sharding as sh
from custlens.llm.queries import QUERIES
from tests.llm.helpers import ODD, SF, docs_frame, sf_table


def check_law(rows, n_docs, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(j, [])) for j in range(shards)]
    assert sum(sizes) == n_docs and max(sizes) - min(sizes) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_over_supplied_documents(spark):
    rows = QUERIES["op12_sharding"](spark, SF).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in sf_table(spark, "documents").collect()}
    check_law(rows, len(docs), sh.SHARDS)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_odd_and_hot_rows(spark, block_rows):
    rows = ODD + [(50, "the same text")] * 80
    docs = docs_frame(spark, rows).repartition(7)
    out = sh.shard_documents(docs, shards=5, block_rows=block_rows)
    got = out.collect()
    check_law(got, len(rows), 5)
    want = Counter((i, len((t or "").encode()) + 8) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == want
    # A plan that is run again deals the stored rows alike.
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("n", [0, 1, 4, 5, 6, 24, 25])
def test_fewer_rows_than_shards_or_none(spark, n):
    check_law(sh.shard_documents(docs_frame(spark, [(i, "x") for i in range(n)])).collect(), n, sh.SHARDS)


def test_whole_rows_with_clashing_names_and_files(spark, scratch):
    df = spark.createDataFrame([(str(i), i, i, i, i, None) for i in range(40)],
                               "`a.b` string, shard int, slot int, part int, block int, row string").repartition(3)
    sh.write_shards(df, f"{scratch}/shards", shards=3, block_rows=5)
    back = spark.read.parquet(f"{scratch}/shards")
    check_law(back.collect(), 40, 3)
    assert sorted(r["part"] for r in back.collect()) == list(range(40)) and "a.b" in back.columns


def test_matrix_rows_agree_and_add_up():
    counts, sizes = np.array([5, 0, 17, 100, 3, 1]), np.array([40, 30, 0, 50, 6])
    total = np.zeros(5, np.int64)
    for part, n in enumerate(counts):
        to, rows = sh.matrix_row(counts, part, sizes, seed=3)
        assert rows.sum() == n and (rows > 0).all()
        total[to] += rows
    assert (total == sizes).all()


def test_dealing_is_uniform():
    """Entries of the matrix have the means and variances of the hypergeometric law."""
    counts, sizes = np.array([6, 10, 4, 12]), np.array([8, 8, 16])
    seen = np.zeros((3000, 4, 3))
    for seed in range(3000):
        for part in range(4):
            to, rows = sh.matrix_row(counts, part, sizes, seed)
            seen[seed, part, to] = rows
    n = counts.sum()
    mean = np.outer(counts, sizes) / n
    var = np.outer(counts * (n - counts), sizes * (n - sizes)) / n / n / (n - 1)
    assert np.abs(seen.mean(axis=0) - mean).max() < 5 * np.sqrt(var.max() / 3000)
    assert np.abs(seen.var(axis=0) / var - 1).max() < 0.15


def test_every_shard_and_slot_is_equally_likely(spark):
    docs = docs_frame(spark, [(i, "x") for i in range(12)]).repartition(4).checkpoint()
    hits, runs = np.zeros((12, 3)), 60
    for seed in range(runs):
        for r in sh.shard_documents(docs, shards=3, seed=seed).collect():
            hits[r["doc_id"], r["shard"]] += 1
    chi = ((hits - runs / 3) ** 2 / (runs / 3)).sum()
    assert chi < 60  # 24 degrees of freedom


def test_hypergeometric_law_and_large_numbers():
    for good, bad, draws in [(5, 7, 4), (30, 10, 25), (400, 300, 350)]:
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            exact = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert math.isclose(math.exp(sh.log_hypergeometric(k, good, bad, draws)), exact, rel_tol=1e-9)
    rng = np.random.default_rng(0)
    drawn = Counter(sh.hypergeometric(rng, 30, 20, 12, limit=0) for _ in range(4000))
    for k in range(3, 12):
        p = math.comb(30, k) * math.comb(20, 12 - k) / math.comb(50, 12)
        assert abs(drawn[k] - 4000 * p) < 5 * math.sqrt(4000 * p)
    good, bad, draws = 7 * 10 ** 10, 3 * 10 ** 10, 10 ** 10
    some = np.array([sh.hypergeometric(rng, good, bad, draws) for _ in range(300)], float)
    sd = math.sqrt(draws * 0.7 * 0.3 * 0.9)
    assert abs(some.mean() - 0.7 * draws) < 5 * sd / math.sqrt(300) and 0.8 < some.std() / sd < 1.2
    split = sh.multivariate(rng, np.full(40, 10 ** 9), 2 * 10 ** 10)
    assert split.sum() == 2 * 10 ** 10 and (split <= 10 ** 9).all()
