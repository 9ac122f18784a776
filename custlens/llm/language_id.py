"""Language of documents by a linear-chain conditional random field over their words.

Every word (run of letters, lower-cased) gets a score per language from its hashed
prefixes and suffixes of one to three characters, its bigrams and trigrams (with word
edges), and a lexicon: the log share of the word among each language's words, counted
in Spark over all documents that may be learnt from and kept in 2^18 hashed buckets.
Learned transitions link neighbouring words, so texts that switch languages are
labelled word by word: the forward-backward algorithm gives each word's posterior.

The field is trained in numpy on sequences of 1 to 3 segments drawn from at most
``MAX_FIT_DOCS`` documents (those with the least hashed ids), which teaches switches.

A document's language is the one with the largest sum of word posteriors, its score the
mean posterior of that language.  Chains are exact over whole texts: they are cut into
chunks whose transfer matrices are multiplied, so a long text needs no long loop.

Special rows: a null text, or one without a letter, gives ``und`` with score 0; a null
``lang`` is not learnt from; without any language to learn all rows are ``und``;
repeated rows give a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import hashed_place, held_out, persisted, sample_by_hash

MAX_FIT_DOCS = 1500
FIT_CHARS = 3000       # characters of a sampled document that segments are drawn from
FEATURE_BITS = 16
LEXICON_BITS = 18
CHUNK = 128
SLICE = 2 << 20        # text bytes handled at once: chains of many documents share their steps
UNKNOWN = "und"

_U = np.uint64
# Non-letters among the code points below 0x3100; everything above counts as a letter.
_LETTER = np.ones(0x3101, dtype=bool)
_LETTER[:128] = False
_LETTER[97:123] = True
_LETTER[65:91] = True
_LETTER[0x80:0xC0] = False
_LETTER[[0xAA, 0xB5, 0xBA]] = True
_LETTER[[0xD7, 0xF7]] = False
_LETTER[0x2000:0x2C00] = False
_LETTER[0x3000:0x3040] = False


@dataclass
class Words:
    """Distinct words of a slice and where they occur."""

    of: np.ndarray       # distinct word of each word in text order
    offs: np.ndarray     # word offsets of the documents
    hashes: np.ndarray   # per distinct word
    chars: np.ndarray    # code points of the distinct words, concatenated
    bounds: np.ndarray   # their offsets into chars


def split_words(texts: pa.Array) -> Words:
    cps, offs = tk.code_points(texts, lower=True)
    letter = _LETTER[np.minimum(cps, 0x3100)]
    inside = np.zeros(len(cps) + 2, dtype=bool)
    inside[1:-1] = letter
    begins, finishes = letter & ~inside[:-2], letter & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(cps))]
    begins[edge] |= letter[edge]
    finishes[edge - 1] |= letter[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    woffs = np.searchsorted(starts, offs)
    if not len(starts):
        return Words(np.zeros(0, np.int64), woffs, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(1, np.int64))
    kept = cps[letter].astype(np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(len(kept)) - np.repeat(first, lens)
    part = tk.mix64(kept * _U(0x9E3779B97F4A7C15) + place.astype(np.uint64))
    h = tk.mix64(np.add.reduceat(part, first))
    hashes, at, of = np.unique(h, return_index=True, return_inverse=True)
    n = lens[at]
    bounds = np.concatenate([[0], np.cumsum(n)])
    take = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(first[at], n)
    return Words(of, woffs, hashes, kept[take].astype(np.uint32), bounds)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature buckets, offsets) of the distinct words, grouped by word."""
    n = len(w.hashes)
    lens = np.diff(w.bounds)
    c = w.chars.astype(np.uint64) + _U(1)
    word = np.repeat(np.arange(n), lens)
    place = np.arange(len(c)) - np.repeat(w.bounds[:-1], lens)
    left = np.repeat(lens, lens) - place - 1
    zero = np.zeros(2, np.uint64)
    c1, c2 = np.concatenate([c[1:], zero[:1]]), np.concatenate([c[2:], zero])
    base = _U(0x10001)
    two = c * base + np.where(left >= 1, c1, _U(0))
    three = two * base + np.where(left >= 2, c2, _U(0))
    out_word, out_key = [], []

    def add(mask, key, kind):
        out_word.append(word[mask])
        out_key.append(tk.mix64(key[mask] * _U(31) + _U(kind)))

    begin = place == 0
    add(begin, c, 1)
    add(begin & (left >= 1), two, 2)
    add(begin & (left >= 2), three, 3)
    add(left == 0, c, 4)
    add(left == 1, two, 5)
    add(left == 2, three, 6)
    add(left >= 1, two, 7)
    add(left >= 2, three, 8)
    words_, keys = np.concatenate(out_word), np.concatenate(out_key)
    order = np.argsort(words_, kind="stable")
    feats = (keys[order] >> _U(64 - FEATURE_BITS)).astype(np.int64)
    return feats, np.searchsorted(words_[order], np.arange(n + 1))


def _group_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Row sums of values[offs[i]:offs[i+1]] (every group has a member)."""
    return np.add.reduceat(values, offs[:-1], axis=0) if len(offs) > 1 else np.zeros((0, values.shape[1]), values.dtype)


@dataclass
class Field:
    """The trained random field."""

    langs: list
    lexicon: np.ndarray      # (2^LEXICON_BITS, languages) log shares, centred
    weights: np.ndarray      # (2^FEATURE_BITS, languages)
    lexicon_weight: float
    bias: np.ndarray
    transitions: np.ndarray  # (languages, languages)

    def emissions(self, w: Words) -> np.ndarray:
        """Scores (distinct words, languages)."""
        feats, offs = word_features(w)
        lex = self.lexicon[(w.hashes >> _U(64 - LEXICON_BITS)).astype(np.int64)]
        return _group_sum(self.weights[feats], offs) + self.lexicon_weight * lex + self.bias

    def posteriors(self, local: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Word posteriors (words, languages) from exp-scores ``local`` of chained documents."""
        n_lang = local.shape[1]
        move = np.exp(self.transitions - self.transitions.max())
        n_words = np.diff(offs)
        n_chunks = -(-n_words // CHUNK)
        total = int(n_chunks.sum())
        doc = np.repeat(np.arange(len(n_words)), n_chunks)
        nth = np.arange(total) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        start = offs[doc] + nth * CHUNK
        size = np.minimum(CHUNK, offs[doc + 1] - start)
        order = np.argsort(-size, kind="stable")
        start_o, size_o = start[order], size[order]
        active = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(int(size_o[0]) if total else 0)]
        # Transfer matrix of each chunk.
        m = np.repeat(np.eye(n_lang, dtype=np.float64)[None], total, axis=0)
        for t, k in enumerate(active):
            step = (m[:k] @ move) * local[start_o[:k] + t][:, None, :]
            m[:k] = step / step.max(axis=(1, 2), keepdims=True)
        matrix = np.empty_like(m)
        matrix[order] = m
        # Messages into each chunk, chunk after chunk of all documents at once.
        fwd = np.ones((total, n_lang))
        bwd = np.ones((total, n_lang))
        first = np.cumsum(n_chunks) - n_chunks
        for j in range(1, int(n_chunks.max()) if total else 0):
            at = first[n_chunks > j] + j
            f = np.einsum("ni,nij->nj", fwd[at - 1], matrix[at - 1])
            fwd[at] = f / f.sum(axis=1, keepdims=True)
            at = (first + n_chunks - 1)[n_chunks > j] - j
            b = np.einsum("nij,nj->ni", matrix[at + 1], bwd[at + 1])
            bwd[at] = b / b.sum(axis=1, keepdims=True)
        alpha = np.empty_like(local)
        a = fwd[order]
        for t, k in enumerate(active):
            x = (a[:k] @ move) * local[start_o[:k] + t]
            a[:k] = x / x.sum(axis=1, keepdims=True)
            alpha[start_o[:k] + t] = a[:k]
        b = bwd[order]
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            rows = start_o[:k] + t
            post = alpha[rows] * b[:k]
            alpha[rows] = post / post.sum(axis=1, keepdims=True)
            x = (local[rows] * b[:k]) @ move.T
            b[:k] = x / x.sum(axis=1, keepdims=True)
        return alpha

    def label(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per document: index of its language (-1 without a word) and score."""
        w = split_words(texts)
        n = len(w.offs) - 1
        if not len(w.of):
            return np.full(n, -1), np.zeros(n)
        e = self.emissions(w).astype(np.float64)
        local = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -50.0))[w.of]
        post = self.posteriors(local, w.offs)
        sums = np.stack([tk.per_doc_sum(np.ascontiguousarray(post[:, k]), w.offs) for k in range(post.shape[1])], axis=1)
        n_words = np.diff(w.offs)
        best = sums.argmax(axis=1)
        score = sums[np.arange(n), best] / np.maximum(n_words, 1)
        return np.where(n_words > 0, best, -1), np.clip(score, 0.0, 1.0)


def _count_words(langs: list):
    index = {l: i for i, l in enumerate(langs)}

    def run(batches):
        counts = np.zeros((len(langs), 1 << LEXICON_BITS), np.int64)
        for batch in batches:
            of = np.array([index[l] for l in batch.column("lang").to_pylist()], np.int64)
            for a, b in tk.slices(batch.column("text")):
                w = split_words(batch.column("text").slice(a, b - a))
                bucket = (w.hashes >> _U(64 - LEXICON_BITS)).astype(np.int64)[w.of]
                lang = np.repeat(of[a:b], np.diff(w.offs))
                for i in np.unique(lang):
                    counts[i] += np.bincount(bucket[lang == i], minlength=1 << LEXICON_BITS)
        for i in range(len(langs)):
            at = np.flatnonzero(counts[i])
            for s in range(0, len(at), 65536):
                part = at[s: s + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), i)), pa.array(part), pa.array(counts[i, part])], names=["lang", "bucket", "n"])

    return run


def _train(field: Field, w: Words, lang_of_doc: np.ndarray, steps=160, batch=48, length=48, rate=0.05, seed=3):
    """Adam on code-switched sequences drawn from the sampled documents."""
    rng = np.random.default_rng(seed)
    feats, offs = word_features(w)
    lex = field.lexicon[(w.hashes >> _U(64 - LEXICON_BITS)).astype(np.int64)].astype(np.float64)
    used, col = np.unique(feats, return_inverse=True)
    per_word = np.diff(offs)
    n_lang = len(field.langs)
    p = {"w": np.zeros((len(used), n_lang)), "v": np.ones(1), "b": np.zeros(n_lang), "t": np.eye(n_lang)}
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    n_words = np.diff(w.offs)
    docs = np.flatnonzero(n_words > 0)
    by_lang = [docs[lang_of_doc[docs] == i] for i in range(n_lang)]
    by_lang = [d for d in by_lang if len(d)]
    for step in range(1, steps + 1):
        ids = np.zeros((length, batch), np.int64)
        y = np.zeros((length, batch), np.int64)
        for s in range(batch):
            at, parts = 0, int(rng.integers(1, 4))
            while at < length:
                group = by_lang[int(rng.integers(len(by_lang)))]
                d = int(group[int(rng.integers(len(group)))])
                size = min(length - at, max(3, length // parts), int(n_words[d]))
                a = int(w.offs[d]) + int(rng.integers(0, n_words[d] - size + 1))
                ids[at: at + size, s] = w.of[a: a + size]
                y[at: at + size, s] = lang_of_doc[d]
                at += size
        words_, inv = np.unique(ids, return_inverse=True)
        inv = inv.reshape(ids.shape)
        lens = per_word[words_]
        flat = np.repeat(offs[words_], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        cols = col[flat]
        e = np.add.reduceat(p["w"][cols], np.cumsum(lens) - lens, axis=0) + p["v"] * lex[words_] + p["b"]
        local = np.exp(e - e.max(axis=1, keepdims=True))[inv]
        move = np.exp(p["t"])
        alpha, scale = np.zeros_like(local), np.zeros((length, batch, 1))
        beta = np.ones_like(local)
        a = np.ones((batch, n_lang))
        for t in range(length):
            a = (a @ move) * local[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            a = alpha[t] = a / scale[t]
        d_t = np.zeros_like(move)
        for t in range(length - 1, 0, -1):
            g = local[t] * beta[t] / scale[t]
            d_t += alpha[t - 1].T @ g
            beta[t - 1] = g @ move.T
        d_t *= move
        np.add.at(d_t, (y[:-1].ravel(), y[1:].ravel()), -1)
        de = alpha * beta
        de /= de.sum(axis=2, keepdims=True)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        du = np.zeros_like(e)
        np.add.at(du, inv.ravel(), de.reshape(-1, n_lang))
        grads = {"b": du.sum(axis=0), "v": np.array([(du * lex[words_]).sum()]), "t": d_t,
                 "w": np.stack([np.bincount(cols, weights=np.repeat(du[:, k], lens), minlength=len(used))
                                for k in range(n_lang)], axis=1)}
        for k, x in p.items():
            q = grads[k] / batch + (1e-3 * x if k in ("w", "t") else 0)
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            x -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)
    field.weights[used] = p["w"]
    field.lexicon_weight, field.bias, field.transitions = float(p["v"][0]), p["b"], p["t"]


def fit(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Field | None:
    """A field for the languages of the documents that may be learnt from."""
    train = docs.select("doc_id", "text", "lang").where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    if not langs:
        return None
    counted = persisted(
        train.select("text", "lang").mapInArrow(_count_words(langs), "lang long, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    counts = np.zeros((1 << LEXICON_BITS, len(langs)))
    counts[counted["bucket"].to_numpy(), counted["lang"].to_numpy()] = counted["n"].to_numpy()
    share = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (1 << LEXICON_BITS)))
    share -= share.mean(axis=1, keepdims=True)
    field = Field(langs, share.astype(np.float32), np.zeros((1 << FEATURE_BITS, len(langs)), np.float32), 1.0,
                  np.zeros(len(langs)), np.eye(len(langs)))
    sample = sample_by_hash(train, max_fit_docs, F.substring("text", hashed_place(FIT_CHARS), F.lit(FIT_CHARS)).alias("text"), "lang").toArrow()
    w = split_words(sample["text"].combine_chunks())
    if len(w.of):
        _train(field, w, np.array([langs.index(l) for l in sample["lang"].to_pylist()]))
    return field


def identify(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    field = field or fit(docs)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text",
                       F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    if field is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    # At most 2^18 + 2^16 rows of numbers per language.
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        f = shared.value
        best, score = f.label(batch.column("text"))
        known = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
        # Letters outside the word table's ranges only: the first language, without confidence.
        names = [UNKNOWN if not k else f.langs[max(int(i), 0)] for i, k in zip(best, known)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(np.where(known, score, 0.0))],
            names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(tk.map_slices(run, limit=SLICE), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
