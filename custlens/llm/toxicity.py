"""Toxicity scores: a linear classifier on character n-grams scaled by naive Bayes
log-count ratios.

* Features: the distinct character 3-, 4- and 5-grams of the lower-cased text, hashed
  to 2^18 buckets.
* Ratios: for every bucket the number of toxic and of clean labelled documents that
  have it is counted over all labelled documents that may be learnt from (in Spark,
  one partial count per task).  The ratio is the log of the smoothed share among toxic
  documents over that among clean ones; the smoothing is in proportion to the class
  sizes, so an unseen or rare bucket has a ratio near 0.
* Classifier: logistic regression on ``ratio * presence``, fitted on a sample of at
  most ``max_fit_docs`` labelled documents (the ones with the least hashed ids, half
  of each class where there are enough) with equal class weights, so that a score of
  0.5 weighs both kinds of error alike.

Special rows: a null or empty text has no feature and gets the intercept's score; a
text shorter than three characters likewise; repeated rows are scored each; without any
label, or with labels of one class only, every score is the smoothed label share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import broadcast_if_small, held_out, persisted, with_free_names

BITS = 18
ORDERS = (3, 4, 5)
MAX_FIT_DOCS = 1200


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams: (bucket, document offsets), sorted within a document."""
    cps, offs = tk.code_points(texts, lower=True)
    n_docs = len(offs) - 1
    lens = np.diff(offs)
    doc = np.repeat(np.arange(n_docs, dtype=np.uint64) << np.uint64(BITS), lens)
    keys = []
    rolled = cps.astype(np.uint32)
    base = np.uint32(0x01000193)
    for n in range(2, max(ORDERS) + 1):
        if len(cps) < n:
            break
        rolled = rolled[:-1] * base + cps[n - 1:]
        if n not in ORDERS:
            continue
        inside = np.ones(len(cps), dtype=bool)
        for k in range(1, n):  # n-grams must end within their document
            at = offs[1:] - k
            inside[at[at >= offs[:-1]]] = False
        inside = inside[: len(rolled)]
        bucket = ((rolled ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        keys.append((doc[: len(rolled)] | bucket)[inside])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(n_docs + 1, np.int64)
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    bounds = np.searchsorted(key, np.arange(n_docs + 1, dtype=np.uint64) << np.uint64(BITS))
    return (key & np.uint64((1 << BITS) - 1)).astype(np.int64), bounds


def _count_features(batches):
    """Per task: how many toxic and clean documents have each bucket."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), dtype=bool)
        for a, b in tk.slices(batch.column("text")):
            bucket, offs = features(batch.column("text").slice(a, b - a))
            of = np.repeat(toxic[a:b], np.diff(offs))
            counts[1] += np.bincount(bucket[of], minlength=1 << BITS)
            counts[0] += np.bincount(bucket[~of], minlength=1 << BITS)
    seen = np.flatnonzero(counts.any(axis=0))
    for a in range(0, len(seen), 65536):
        part = seen[a: a + 65536]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(counts[1, part]), pa.array(counts[0, part])], names=["bucket", "toxic", "clean"])


@dataclass
class ToxicityModel:
    """``weights`` per bucket (ratio times fitted weight) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, offs = features(texts)
        z = tk.per_doc_sum(self.weights[bucket].astype(np.float64), offs) + self.intercept
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _fit_linear(bucket, offs, y, ratio, l2=1e-4, rounds=60):
    """Logistic regression on ratio-scaled presence features."""
    n = len(y)
    share = max(y.mean(), 1e-6)
    sample_weight = np.where(y == 1, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / n

    # Documents go through in small parts, so that temporary arrays stay small.
    parts = [(a, min(a + 100, n)) for a in range(0, n, 100)]

    def scores(w):
        scaled = (w * ratio).astype(np.float32)
        return np.concatenate([
            tk.per_doc_sum(scaled[bucket[offs[a]: offs[b]]], offs[a: b + 1] - offs[a]) for a, b in parts])

    def pull(row_values):
        total = np.zeros(1 << BITS)
        for a, b in parts:
            weights = np.repeat(row_values[a:b], np.diff(offs[a: b + 1]))
            total += np.bincount(bucket[offs[a]: offs[b]], weights=weights, minlength=1 << BITS)
        return total * ratio

    # The loss bends at most by a quarter of the largest eigenvalue, found by power iteration.
    v = pull(sample_weight)
    for _ in range(6):
        v = pull(sample_weight * scores(v / (np.linalg.norm(v) + 1e-12)))
    step = 1.0 / (0.25 * np.linalg.norm(v) + l2 + 1e-12)
    # Accelerated gradient steps: strong, frequent features move first, so that features
    # of single documents are not learnt by heart.
    w, b = np.zeros(1 << BITS), 0.0
    ahead, ahead_b = w, b
    for k in range(rounds):
        error = sample_weight * (1.0 / (1.0 + np.exp(-np.clip(scores(ahead) + ahead_b, -30, 30))) - y)
        new = ahead - step * (pull(error) + l2 * ahead)
        new_b = ahead_b - 2.0 * error.sum()
        ahead = new + k / (k + 3.0) * (new - w)
        ahead_b = new_b + k / (k + 3.0) * (new_b - b)
        w, b = new, new_b
    seen = np.bincount(bucket, minlength=1 << BITS) > 0
    return np.where(seen, w * ratio, 0.0), b


def fit(docs: DataFrame, labels: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> ToxicityModel:
    """Fit on the labelled documents that are not held out."""
    marked = persisted(labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
                       .agg((F.max("toxic") == 1).alias("toxic")).where(~held_out(F.col("doc_id"))))
    train = docs.select("doc_id", "text").join(broadcast_if_small(marked), "doc_id")
    # Bounded: 2^BITS rows at most.
    counted = (
        train.select("toxic", "text").mapInArrow(_count_features, "bucket long, toxic long, clean long")
        .groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    stored = persisted(counted.unionByName(
        train.agg(F.lit(-1).cast("long").alias("bucket"), F.sum(F.col("toxic").cast("long")).alias("toxic"),
                  F.sum((~F.col("toxic")).cast("long")).alias("clean"))))
    table = stored.toArrow()
    at = table["bucket"].to_numpy()
    n_toxic, n_clean = (int(table[c].fill_null(0).to_numpy()[at == -1][0]) for c in ("toxic", "clean"))
    prior = (n_toxic + 1.0) / (n_toxic + n_clean + 2.0)
    flat = ToxicityModel(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    if not n_toxic or not n_clean:
        return flat
    counts = np.zeros((2, 1 << BITS))
    known = at >= 0
    counts[1, at[known]] = table["toxic"].to_numpy()[known]
    counts[0, at[known]] = table["clean"].to_numpy()[known]
    total = n_toxic + n_clean
    ratio = np.log((counts[1] + 2.0 * n_toxic / total) / (n_toxic + 2.0 * n_toxic / total)) - np.log(
        (counts[0] + 2.0 * n_clean / total) / (n_clean + 2.0 * n_clean / total))
    order = F.xxhash64("doc_id")
    half = max_fit_docs // 2
    # Ids first, so that only the sampled texts move.
    known = docs.select("doc_id").join(broadcast_if_small(marked), "doc_id")
    chosen = (
        known.where("toxic").orderBy(order, "doc_id").limit(half)
        .unionByName(known.where("NOT toxic").orderBy(order, "doc_id").limit(half)).distinct()
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_fit_docs ids
    rows = rows.withColumn("h", F.xxhash64("text"))
    # An id may hold many rows: the classes are cut again, to half of the bound each.
    sample = (
        rows.where("toxic").orderBy(order, "doc_id", "h").limit(half)
        .unionByName(rows.where("NOT toxic").orderBy(order, "doc_id", "h").limit(half))
        .orderBy(order, "doc_id", "h").select("text", "toxic").toArrow()
    )
    del table
    y = sample["toxic"].to_numpy().astype(np.float64)
    parts, base, bounds = [], 0, [np.zeros(1, np.int64)]
    texts = sample["text"].combine_chunks()
    for a, b in tk.slices(texts):
        bucket, offs = features(texts.slice(a, b - a))
        keep = np.abs(ratio[bucket]) > 0.05  # what carries no evidence keeps weight 0
        kept = np.concatenate([[0], np.cumsum(keep)])
        parts.append(bucket[keep].astype(np.int32))
        bounds.append(kept[offs[1:]] + base)
        base += int(keep.sum())
    if not len(y) or y.min() == y.max() or not base:
        return flat
    buckets = np.concatenate(parts)
    del parts, texts, sample
    weights, intercept = _fit_linear(buckets, np.concatenate(bounds), y, ratio)
    return ToxicityModel(weights.astype(np.float32), float(intercept))


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a ``toxicity`` column (0 to 1) per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the input
    names = list(keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score(batch.column("text"))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s)], names=[*names, "toxicity"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(tk.map_slices(run), f"{schema}, toxicity double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more, with all their columns, whatever they
    are called."""
    model = fit(docs, labels)

    def kept(rows: DataFrame) -> DataFrame:
        return score(rows, model, tuple(rows.columns)).where("toxicity < 0.5").drop("toxicity")

    return with_free_names(docs, ("toxicity",), kept)
