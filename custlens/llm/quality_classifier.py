"""Document quality from a label model over heuristic labellers and a hashed scorer.

* Labellers.  Nine heuristics vote good (1), bad (0) or abstain (-1) on every text: its
  share of letters, of upper-case letters, of symbols, of words equal to the word before
  them, of repeated lines, of words without a letter or digit, its number of words, how
  many words end sentences, and the share of its most frequent word.  They overlap and
  are noisy.
* Label model.  Votes are counted per vote pattern in Spark (at most 3^9 patterns,
  whatever the corpus); expectation-maximisation on these counts estimates the share
  of good documents and each labeller's chance of voting good, bad or nothing for good
  and for bad documents.  Labellers are taken as independent given the quality, with
  Dirichlet priors that make each better than chance.
* Scorer.  The posterior of a document's vote pattern is its soft label; a logistic
  regression on hashed words and numeric buckets learns it from at most
  ``MAX_FIT_DOCS`` documents (those with the least hashed ids), so that texts on which
  all labellers abstain are scored by their content.  The final score is the mean of
  the pattern's posterior and the scorer, in log-odds.

Null and empty texts are scored as bad (the labellers' word count votes so); repeated
rows count as often as they come and get a row each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import sample_by_hash

MAX_FIT_DOCS = 2000
BITS = 16
EM_ROUNDS = 200
LABELLERS = ("letters", "upper", "symbols", "repeated_words", "repeated_lines", "bare_words", "length", "sentences", "dominant")

_U = np.uint64


def _byte_class(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[[ord(c) for c in chars]] = True
    return t


_LETTERS = _byte_class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS[0xC0:] = True      # first bytes of characters beyond ASCII
_UPPER = _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_SYMBOL = _byte_class("#*$%&|<>{}[]\\^~_=@")
_ENDS = _byte_class(".!?")


def measures(texts: pa.Array):
    """Per document: the labellers' measures (documents x 9), word hashes and offsets."""
    data, offs = tk.utf8(texts)
    h, woff, starts, ends = tk.words(data, offs, tk.word_byte_table("space"))
    low, lowoff, _, _ = tk.words(data, offs, tk.word_byte_table("alnum"))
    n = len(offs) - 1
    chars = np.maximum(tk.per_doc_sum(((data & 0xC0) != 0x80).astype(np.int64), offs), 1)
    white = tk.per_doc_sum(((data == 32) | ((data >= 9) & (data <= 13))).astype(np.int64), offs)
    solid = np.maximum(chars - white, 1)
    letters = tk.per_doc_sum(_LETTERS[data].astype(np.int64), offs)
    n_words = np.diff(woff)
    some = np.maximum(n_words, 1)
    upper = tk.per_doc_sum(_UPPER[data].astype(np.int64), offs) / np.maximum(letters, 1)
    symbols = tk.per_doc_sum(_SYMBOL[data].astype(np.int64), offs) / solid
    # Words equal to the word before them, and the most frequent word's share, per document.
    same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
    same[woff[:-1][n_words > 0]] = False
    stutter = tk.per_doc_sum(same.astype(np.int64), woff) / some
    doc = np.repeat(np.arange(n, dtype=np.uint64), n_words)
    key = np.sort((doc << _U(40)) | (h >> _U(24)))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    runs = np.diff(np.concatenate([head, [len(key)]]))
    most = np.zeros(n, np.int64)
    if len(head):
        np.maximum.at(most, (key[head] >> _U(40)).astype(np.int64), runs)
    lines = tk.per_doc_sum((data == 10).astype(np.int64), offs)
    repeated = np.zeros(n)
    for i in np.flatnonzero(lines):
        own = [x for x in data[offs[i]: offs[i + 1]].tobytes().split(b"\n") if x.strip()]
        repeated[i] = 1.0 - len(set(own)) / len(own) if own else 0.0
    # Words without a letter, digit or non-ASCII character.
    bare = tk.word_byte_table("alnum")[data] > 0
    inside = np.concatenate([[0], np.cumsum(bare)])
    lone = tk.per_doc_sum((inside[ends] == inside[starts]).astype(np.int64), woff) / some
    stops = tk.per_doc_sum(_ENDS[data].astype(np.int64), offs) / some
    m = np.stack([letters / solid, upper, symbols, stutter, repeated, lone, n_words.astype(np.float64),
                  stops, most / some], axis=1)
    return m, low, lowoff


def vote(m: np.ndarray) -> np.ndarray:
    """Votes (documents x 9): 1 good, 0 bad, -1 abstain."""
    def rule(x, good, bad):
        return np.where(bad(x), 0, np.where(good(x), 1, -1))

    never = lambda x: np.zeros(len(x), bool)
    some = m[:, 6] >= 10
    v = [
        rule(m[:, 0], never, lambda x: (m[:, 6] >= 30) & (x < 0.8)),
        rule(m[:, 1], never, lambda x: x > 0.4),
        rule(m[:, 2], never, lambda x: x > 0.03),
        rule(m[:, 3], never, lambda x: some & (x > 0.15)),
        rule(m[:, 4], never, lambda x: (m[:, 6] >= 30) & (x > 0.3)),
        rule(m[:, 5], never, lambda x: some & (x > 0.1)),
        rule(m[:, 6], never, lambda x: x < 3),
        rule(m[:, 7], lambda x: (x >= 0.02) & (x <= 0.25), lambda x: ((m[:, 6] >= 50) & (x < 0.02)) | (x > 0.6)),
        rule(m[:, 8], never, lambda x: some & (x > 0.25)),
    ]
    return np.stack(v, axis=1)


def pattern(votes: np.ndarray) -> np.ndarray:
    """One number per vote pattern, in base 3."""
    return (votes + 1) @ (3 ** np.arange(votes.shape[1]))


def unpack(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS))) % 3 - 1


@dataclass
class LabelModel:
    """Share of good documents and P(vote | quality), votes in order abstain, bad, good."""

    good: float
    chance: np.ndarray   # (2, labellers, 3): for bad, for good

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        k = np.arange(votes.shape[1])
        ratio = np.log(self.chance[1][k, votes + 1]) - np.log(self.chance[0][k, votes + 1])
        return np.log(self.good) - np.log(1 - self.good) + ratio.sum(axis=1)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = EM_ROUNDS) -> LabelModel:
    """Fit to the distinct vote patterns and how often each occurs."""
    n_lab = votes.shape[1]
    # Dirichlet priors, in pseudo-documents: each labeller is better than chance.
    # A vote for bad is rare among good documents.
    weight = max(1.0, 0.05 * count.sum())
    prior = weight * np.array([[[0.4, 0.4, 0.2]], [[0.49, 0.01, 0.5]]])
    # A labeller that never votes good says nothing by abstaining for good ones.
    silent = np.array([not (votes[:, k] == 1).any() for k in range(n_lab)])
    prior = np.repeat(prior, n_lab, axis=1)
    prior[0, silent] = weight * np.array([0.59, 0.4, 0.01])
    prior[1, silent] = weight * np.array([0.98, 0.01, 0.01])
    model = LabelModel(0.85, prior / prior.sum(axis=2, keepdims=True))
    for _ in range(rounds):
        post = 1.0 / (1.0 + np.exp(-np.clip(model.log_odds(votes), -40, 40)))
        chance = prior.copy()
        for q, share in ((0, 1 - post), (1, post)):
            for k in range(n_lab):
                chance[q, k] += np.bincount(votes[:, k] + 1, weights=count * share, minlength=3)
        good = (count @ post + 0.85 * weight) / (count.sum() + weight)
        new = LabelModel(float(np.clip(good, 1e-4, 1 - 1e-4)), chance / chance.sum(axis=2, keepdims=True))
        done = np.abs(new.chance - model.chance).max() < 1e-7
        model = new
        if done:
            break
    return model


def features(m: np.ndarray, words: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features per document: distinct words, and each measure's bucket."""
    n = len(m)
    doc = np.repeat(np.arange(n, dtype=np.uint64) << _U(BITS), np.diff(woff))
    word = doc | (words >> _U(64 - BITS))
    step = np.minimum((np.minimum(np.abs(m), 1e6) * np.array([20, 20, 50, 20, 20, 20, 0.05, 40, 20])).astype(np.int64), 40)
    cell = tk.mix64((step + 64 * np.arange(m.shape[1])).astype(np.uint64) + _U(12345)) >> _U(64 - BITS)
    own = (np.arange(n, dtype=np.uint64) << _U(BITS))[:, None] | cell
    key = np.unique(np.concatenate([word, own.ravel()]))
    bounds = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << _U(BITS))
    return (key & _U((1 << BITS) - 1)).astype(np.int32), bounds


def fit_scorer(bucket, offs, target, rounds=80, l2=3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on presence features scaled by text size."""
    n = len(target)
    lens = np.diff(offs)
    scale = 1.0 / np.sqrt(np.maximum(lens, 1))
    mass = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3)) / n
    w, b = np.zeros(1 << BITS), 0.0
    sq, sqb = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.add.reduceat(w[bucket], offs[:-1]) * scale + b
        error = mass * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        g = np.bincount(bucket, weights=np.repeat(error * scale, lens), minlength=1 << BITS) + l2 * w / n
        gb = error.sum()
        sq += g * g
        sqb += gb * gb
        w -= 0.2 * g / np.sqrt(sq)
        b -= 0.2 * gb / np.sqrt(sqb)
    share = np.clip((target >= 0.5).mean(), 1e-3, 1 - 1e-3)
    return w, b + np.log(share / (1 - share))


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    intercept: float

    def score(self, texts: pa.Array):
        m, words, woff = measures(texts)
        votes = vote(m)
        voted = self.labels.log_odds(votes)
        bucket, offs = features(m, words, woff)
        lens = np.diff(offs)
        learnt = np.add.reduceat(self.weights[bucket], offs[:-1]) / np.sqrt(lens) + self.intercept
        z = 0.5 * (np.clip(voted, -12, 12) + np.clip(learnt, -12, 12))
        return 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(voted, -40, 40))), (votes >= 0).sum(axis=1)


def _vote_batches(batches):
    """Per task: how often each vote pattern occurs."""
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for a, b in tk.slices(batch.column("text")):
            m, _, _ = measures(batch.column("text").slice(a, b - a))
            counts += np.bincount(pattern(vote(m)), minlength=len(counts))
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["pattern", "n"])


def fit(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> QualityModel:
    """The label model from all documents, the scorer from a bounded sample."""
    table = (
        docs.select("text").mapInArrow(_vote_batches, "pattern long, n long")
        .groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    )
    code = table["pattern"].to_numpy()
    if not len(code):
        return QualityModel(LabelModel(0.85, np.full((2, len(LABELLERS), 3), 1 / 3)), np.zeros(1 << BITS), 0.0)
    labels = expectation_maximisation(unpack(code), table["n"].to_numpy().astype(np.float64))
    sample = sample_by_hash(docs.select("doc_id", "text"), max_fit_docs, "text").toArrow()
    texts = sample["text"].combine_chunks()
    parts, bounds, targets, base = [], [np.zeros(1, np.int64)], [], 0
    for a, b in tk.slices(texts):
        m, words, woff = measures(texts.slice(a, b - a))
        targets.append(1 / (1 + np.exp(-np.clip(labels.log_odds(vote(m)), -40, 40))))
        bucket, offs = features(m, words, woff)
        parts.append(bucket)
        bounds.append(offs[1:] + base)
        base += len(bucket)
    weights, intercept = fit_scorer(np.concatenate(parts), np.concatenate(bounds), np.concatenate(targets))
    return QualityModel(labels, weights, float(intercept))


def quality_scores(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better), posterior (of the label model alone),
    n_votes and kept (score of 0.5 or more) for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))  # half a megabyte

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score, posterior, n_votes = shared.value.score(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(score), pa.array(posterior), pa.array(n_votes.astype(np.int32)),
             pa.array(score >= 0.5)], names=["doc_id", "score", "posterior", "n_votes", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tk.map_slices(run), f"doc_id {kind}, score double, posterior double, n_votes int, kept boolean")
