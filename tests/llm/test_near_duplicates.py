from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from custlens.llm import near_duplicates as nd
from tests.llm.helpers import ODD, docs_frame, sf_table


def _grams(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return Counter(tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 0))) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(rows):
    """Least id per class, by comparing all pairs of a small table."""
    g = [_grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if g[i] and g[j]:
                low, high = sum((g[i] & g[j]).values()), sum((g[i] | g[j]).values())
                if low >= 0.8 * high:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def _planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(8, 160))]
        if rng.random() < 0.5:  # unlike texts share a long passage
            base = passage + base[: rng.randint(10, 40)]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_classes_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = _planted(seed)
        got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs_frame(spark, rows)).collect()}
        assert got == brute_classes(rows)


def test_supplied_documents_equal_all_pairs(spark):
    docs = sf_table(spark, "documents")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)


def test_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(4)
    a = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    wa = rng.integers(1, 9, 300)
    wb = np.where(rng.random(300) < 0.3, np.maximum(1, wa // 2), wa)
    keep = rng.random(300) < 0.9
    doc = np.concatenate([np.zeros(300, np.int64), np.ones(int(keep.sum()), np.int64)])
    sig = nd.signatures(doc, np.concatenate([a, a[keep]]), np.concatenate([wa, wb[keep]]), 2, 2000)
    want = np.minimum(wa, wb * keep).sum() / np.maximum(wa, wb * keep).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_signature_does_not_depend_on_the_batch():
    run = nd._signature_batch(120)
    texts = ["one two three four five six seven", "word " * 900, None, "a b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], names=["doc_id", "text"])
    whole = run(batch).column("sig").to_pylist()
    assert whole == [run(batch.slice(i, 1)).column("sig")[0].as_py() for i in range(4)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1064)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_large_groups_of_copies_and_odd_rows(spark):
    rows = ODD + [(100 + i, "copies of one text, many of them in one table") for i in range(500)]
    docs = docs_frame(spark, rows).withColumnsRenamed({"n_chars": "size"})
    out = nd.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    copies = [r for r in out if r["doc_id"] is not None and r["doc_id"] >= 100]
    assert {(r["class_id"], r["class_size"]) for r in copies} == {(100, 500)} and sum(r["keep"] for r in copies) == 1
    assert {r["class_id"] for r in out if r["doc_id"] in (2, 3, 4)} == {2, 3, 4}
    assert nd.near_duplicates(docs.limit(0)).count() == 0
    kept = nd.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id >= 100").count() == 1


def test_pairs_that_no_representative_joins_are_found(spark, monkeypatch):
    monkeypatch.setattr(nd, "BAND_ROWS", 1)  # large mixed buckets
    rng = random.Random(11)
    blocks = [[f"b{i}w{j}" for j in range(12)] for i in range(40)]
    text = lambda chosen: " ".join(w for i in sorted(chosen) for w in blocks[i])
    rows = []
    for i in range(100):  # texts of 30 of 40 blocks, each with one where a block is another
        own = rng.sample(range(40), 30)
        rest = [b for b in range(40) if b not in own]
        rows += [(2 * i, text(own)), (2 * i + 1, text(own[:29] + rest[:1]))]
    want = brute_classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(docs_frame(spark, rows)).collect()}
    assert 20 < len(set(want.values())) < 150
    assert got == want


def test_similar_texts_share_a_prefix_token():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 40, n).astype(np.uint32) << np.uint32(20)
        b = np.where(rng.random(n) < 0.1, rng.integers(0, 40, n).astype(np.uint32) << np.uint32(20), a)
        a, b = np.sort(a), np.sort(b)
        frequency = rng.integers(0, 5, 1 << nd.FREQUENCY_BITS)
        end = np.array([n])
        if nd.weighted_jaccard(a, end, b, end)[0] >= 0.8:
            x, y = list(nd.prefix(a, frequency, 0.8)), list(nd.prefix(b, frequency, 0.8))
            first = next(t for t in x if t in set(y))
            # At the first shared token the places leave room for what the two share.
            assert (n - max(x.index(first), y.index(first))) * 1.8 + 1e-6 >= 0.8 * 2 * n


def test_similarity_of_many_pairs_at_once(monkeypatch):
    rng = np.random.default_rng(8)
    sides = [[np.sort(rng.integers(0, 9, rng.integers(0, 30))).astype(np.uint32) for _ in range(60)] for _ in "ab"]
    want = []
    for a, b in zip(*sides):
        x, y = Counter(a.tolist()), Counter(b.tolist())
        whole = sum((x | y).values())
        want.append(sum((x & y).values()) / whole if whole else 0.0)
    got = nd.weighted_jaccard(*(f(side) for side in sides for f in (np.concatenate, lambda s: np.cumsum([len(p) for p in s]))))
    assert np.allclose(got, want)
    monkeypatch.setattr(nd, "VERIFY_GRAMS", 100)  # many steps a batch
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(60)), pa.array(range(60)), *(pa.array([p.tobytes() for p in side], pa.binary()) for side in sides)],
        names=["a", "b", "grams_a", "grams_b"])
    out = [x for part in nd._verify_batches(0.5)([batch]) for x in part.to_pylist()]
    assert [x["a"] for x in out] == list(range(60)) and [x["similar"] for x in out] == [w >= 0.5 for w in want]


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    copy, clean = "one two three four five six seven eight", "a quite different text that nobody else has"
    other = "yet another text of several words is here"
    rows = [(1, copy), (5, copy), (5, clean), (None, copy), (None, other), (None, other), (7, "same row"), (7, "same row")]
    kept = nd.drop_near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted(
        [("1", copy), ("5", clean), ("None", other), ("7", "same row")])
    assert sum(r["keep"] for r in nd.near_duplicates(docs_frame(spark, rows)).collect()) == 4
