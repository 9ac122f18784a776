"""Quality rules: text statistics, and perplexity bands of a modified Kneser-Ney model.

Words are runs of characters other than the space and the control characters 9-13.

* Base: too few words, or too many words in five-word windows that occur twice or more
  in the text.
* Model: character 4-grams (three start marks before each text) are counted per language
  over all texts in Spark.  Lower orders use continuation counts, every order has its
  own discounts D1, D2, D3+ from its counts of counts, and backoff weights come from the
  contexts' numbers of once, twice and more often seen successors.  A 4-gram seen once
  is only known from the text being scored, so it counts as unseen there.
* Storage: sorted arrays of 64-bit hash keys, one entry per trigram (log probability, log
  backoff weight) and per 4-gram that is known (what it adds to the backed-off value).
  A character's log probability is the sum of its entries, so the model is cut by key
  into as many shards of ``SHARD_ENTRIES`` as its counted n-grams need; every shard is
  sent by itself and the texts' partial sums are added.  No n-gram is left out or
  shares another's value.
* Bands: a text's mean log probability is drawn towards its language's mean as if 200
  further characters had that mean, and a text is rejected when it leaves its language's
  quartiles by more than ``FENCE`` interquartile ranges on either side.

Special rows: null and empty texts have no words and fail the base; a null ``lang`` is a
language of its own; repeated rows are counted as often as they come and each gets a
row; a language with few texts has wide bands of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import persisted

ORDER = 4
CHAR_BITS = 15                     # low bits of a character in ``gram``
HIGH_BITS = 6                      # its other bits, in ``high``
# Entries of the model that a task holds at once (16 bytes each).
SHARD_ENTRIES = 4_000_000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
PRIOR_CHARS = 200
FENCE = 3.0
# Distinct n-grams a counting task holds before it passes them on.
FLUSH = 4_000_000

_U = np.uint64
_MASK = (1 << CHAR_BITS) - 1
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = " \t\n\x0b\x0c\r"


def packed_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 4-gram that ends at each character, packed (low and high bits), and the document offsets."""
    cps, offs = tk.code_points(texts)
    lens = np.diff(offs)
    n = len(lens)
    # Three marks (0) before each text; characters are 1 + code point.
    at = np.arange(len(cps)) + np.repeat((np.arange(n) + 1) * (ORDER - 1), lens)
    sym = np.zeros(len(cps) + n * (ORDER - 1), np.int64)
    sym[at] = cps.astype(np.int64) + 1
    gram = np.zeros(len(cps), np.int64)
    for k in range(ORDER - 1, -1, -1):
        gram = (gram << CHAR_BITS) | (sym[at - k] & _MASK)
    high = np.zeros(len(cps), np.int64)
    if len(cps) and int(sym.max()) > _MASK:
        for k in range(ORDER - 1, -1, -1):
            high = (high << HIGH_BITS) | (sym[at - k] >> CHAR_BITS)
    return gram, high, offs


def _count_batches(batches):
    """Per task: (lang, high, gram, n) of its texts, combined per language and high bits."""
    held: dict = {}

    def emit():
        for (lang, high), (keys, counts) in held.items():
            for a in range(0, len(keys), 65536):
                part = slice(a, a + 65536)
                size = len(keys[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array(np.full(size, high)), pa.array(keys[part]), pa.array(counts[part])],
                    names=["lang", "high", "gram", "n"])
        held.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for a, b in tk.slices(batch.column("text")):
            gram, high, offs = packed_ngrams(batch.column("text").slice(a, b - a))
            names = {l: i for i, l in enumerate(dict.fromkeys(langs[a:b]))}
            of = np.repeat(np.array([names[l] for l in langs[a:b]], np.int64), np.diff(offs))
            for lang, i in names.items():
                mine = gram[of == i] if len(names) > 1 else gram
                tops = high[of == i] if len(names) > 1 else high
                for top in np.unique(tops).tolist():
                    keys, counts = np.unique(mine[tops == top], return_counts=True)
                    if (lang, top) in held:
                        both = np.concatenate([held[lang, top][0], keys])
                        n = np.concatenate([held[lang, top][1], counts])
                        order = np.argsort(both, kind="stable")
                        both, n = both[order], n[order]
                        head = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                        keys, counts = both[head], np.add.reduceat(n, head)
                    held[lang, top] = (keys, counts)
            if sum(len(k) for k, _ in held.values()) > FLUSH:
                yield from emit()
    yield from emit()


def lang_key():
    """A row's language as a key that is never null: no language is one of its own, other
    than the empty text."""
    return F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, high, gram, n): all character 4-grams of all texts."""
    return (
        docs.select(lang_key().alias("lang"), "text").mapInArrow(
            _count_batches, "lang string, high long, gram long, n long")
        .groupBy("lang", "high", "gram").agg(F.sum("n").alias("n"))
    )


def _discounts(grams: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from the counts of counts of one order; one row per language."""
    c = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def d(k, default):
        value = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        return F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.least(F.greatest(value, F.lit(0.05)), F.lit(float(k)))
                      ).otherwise(F.lit(default)).alias(f"d{k}")

    return grams.groupBy("lang").agg(*c).select("lang", d(1, 0.5), d(2, 0.75), d(3, 0.9))


def _last(order: int, high: str, gram: str):
    """The last ``order`` characters of an n-gram, as columns of these names."""
    return (F.col("high").bitwiseAND(F.lit((1 << (HIGH_BITS * order)) - 1)).alias(high),
            F.col("gram").bitwiseAND(F.lit((1 << (CHAR_BITS * order)) - 1)).alias(gram))


def _context(high: str, gram: str):
    """All characters of an n-gram but the last, as columns of these names."""
    return F.shiftright("high", HIGH_BITS).alias(high), F.shiftright("gram", CHAR_BITS).alias(gram)


def kneser_ney(counts: DataFrame) -> list[DataFrame]:
    """Per order 1..4: (lang, high, gram, n, p, backoff).

    ``p`` is the interpolated probability of the last character after the others;
    ``backoff`` the weight that the n-gram, taken as a context, gives to the next lower
    order (1 where it is no context).  Lower orders count distinct left neighbours.
    """
    tables = [counts]
    for order in range(ORDER - 1, 0, -1):
        tables.insert(0, tables[0].groupBy("lang", *_last(order, "high", "gram"))
                      .agg(F.count(F.lit(1)).alias("n")))
    tables = [persisted(t) for t in tables]
    out: list[DataFrame] = []
    for order, grams in enumerate(tables, start=1):
        known = grams.join(F.broadcast(_discounts(grams)), "lang")  # one row per language
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        known = known.select("lang", "high", "gram", "n", discount.alias("d"), *_context("context_high", "context"))
        contexts = known.groupBy("lang", "context_high", "context").agg(
            F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"), F.count(F.lit(1)).alias("types"))
        contexts = persisted(contexts)
        known = known.join(contexts, ["lang", "context_high", "context"])
        first = (F.col("n") - F.col("d")) / F.col("total")
        if order == 1:
            level = known.select("lang", "high", "gram", "n", (first + F.col("weight") / (F.col("types") + 1)).alias("p"))
        else:
            lower = out[-1].select("lang", F.col("high").alias("shorter_high"), F.col("gram").alias("shorter"), F.col("p").alias("p_lower"))
            level = (
                known.select("*", *_last(order - 1, "shorter_high", "shorter")).join(lower, ["lang", "shorter_high", "shorter"])
                .select("lang", "high", "gram", "n", (first + F.col("weight") * F.col("p_lower")).alias("p"))
            )
            # The contexts of this order are n-grams of the one below.
            weights = contexts.select("lang", F.col("context_high").alias("high"), F.col("context").alias("gram"), F.col("weight").alias("backoff"))
            out[-1] = out[-1].join(weights, ["lang", "high", "gram"], "full").select(
                "lang", "high", "gram", F.coalesce("n", F.lit(0)).alias("n"), "p", F.coalesce("backoff", F.lit(1.0)).alias("backoff"))
        out.append(persisted(level))
    out[-1] = out[-1].withColumn("backoff", F.lit(1.0))
    return out


def entry_key(lang_hash: np.ndarray, high: np.ndarray, gram: np.ndarray, order: int) -> np.ndarray:
    """64-bit key of an n-gram of a language."""
    with np.errstate(over="ignore"):
        seed = tk.mix64(lang_hash.astype(np.uint64) + high.astype(np.uint64) * _U(0xD1B54A32D192ED03) + _U(order))
        return tk.mix64(gram.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + seed).view(np.int64)


def language_hash(lang: str | None) -> int:
    h = 1469598103934665603
    for c in (lang or "").encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Shard:
    """Sorted keys with two values: log probability (or what a 4-gram adds) and log backoff weight."""

    keys: np.ndarray
    value: np.ndarray
    backoff: np.ndarray

    def find(self, key: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``values`` of the keys, 0 where a key is not in the shard."""
        if not len(self.keys):
            return np.zeros(len(key))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, values[at], 0.0).astype(np.float64)


def _key_batches(batches):
    for batch in batches:
        langs = np.array([language_hash(l) for l in batch.column("lang").to_pylist()], np.uint64)
        high, gram, order = (batch.column(c).to_numpy() for c in ("high", "gram", "n_chars"))
        keys = np.where(order == ORDER, entry_key(langs, high, gram, ORDER), entry_key(langs, high, gram, ORDER - 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("value"), batch.column("backoff")],
                                         names=["key", "value", "backoff"])


def store(levels: list[DataFrame]) -> list[DataFrame]:
    """The model's entries (key, value, backoff), cut into shards of about ``SHARD_ENTRIES``."""
    low = levels[ORDER - 2].select("lang", "high", "gram", F.log("p").alias("value"), F.log("backoff").alias("backoff"))
    suffix = low.select("lang", F.col("high").alias("h1"), F.col("gram").alias("g1"), F.col("value").alias("lower"))
    before = low.select("lang", F.col("high").alias("h2"), F.col("gram").alias("g2"), F.col("backoff").alias("weight"))
    top = (
        levels[ORDER - 1].where("n > 1").select("lang", "high", "gram", "p", *_last(ORDER - 1, "h1", "g1"), *_context("h2", "g2"))
        .join(suffix, ["lang", "h1", "g1"]).join(before, ["lang", "h2", "g2"])
        .select("lang", "high", "gram", F.lit(ORDER).alias("n_chars"), (F.log("p") - F.col("lower") - F.col("weight")).alias("value"),
                F.lit(0.0).alias("backoff"))
    )
    low = low.select("lang", "high", "gram", F.lit(ORDER - 1).alias("n_chars"), F.coalesce("value", F.lit(0.0)).alias("value"), "backoff")
    entries = persisted(
        low.unionByName(top).mapInArrow(_key_batches, "key long, value double, backoff double")
        .select("key", F.col("value").cast("float").alias("value"), F.col("backoff").cast("float").alias("backoff")))
    shards = max(1, -(-entries.count() // SHARD_ENTRIES))
    return [entries.where(F.pmod("key", F.lit(shards)) == i) for i in range(shards)]


def load(shard: DataFrame) -> Shard:
    """One shard as sorted arrays."""
    table = shard.toArrow()
    keys = table["key"].to_numpy()
    order = np.argsort(keys)
    return Shard(keys[order], *(table[c].to_numpy()[order].astype(np.float32) for c in ("value", "backoff")))


def log_probabilities(gram: np.ndarray, high: np.ndarray, lang_hash: np.ndarray, shard: Shard) -> np.ndarray:
    """What a shard adds to the log probability of each character after the three before it."""
    keys, first, back = np.unique(entry_key(lang_hash, high, gram, ORDER), return_index=True, return_inverse=True)
    g, h, l = gram[first], high[first], lang_hash[first]
    cut, cut_high = (1 << (CHAR_BITS * (ORDER - 1))) - 1, (1 << (HIGH_BITS * (ORDER - 1))) - 1
    total = shard.find(keys, shard.value)
    total += shard.find(entry_key(l, h & cut_high, g & cut, ORDER - 1), shard.value)
    total += shard.find(entry_key(l, h >> HIGH_BITS, g >> CHAR_BITS, ORDER - 1), shard.backoff)
    return total[back]


def text_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words per document."""
    data, offs = tk.utf8(texts)
    h, woff, starts, ends = tk.words(data, offs, tk.word_byte_table("space"))
    n_words = np.diff(woff)
    n_docs = len(n_words)
    # Code points: bytes that do not go on a character; white space is one byte each.
    first = (data & 0xC0) != 0x80
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word_chars = tk.per_doc_sum((first & ~white).astype(np.int64), offs)
    n_symbols = tk.per_doc_sum(_SYMBOLS[data].astype(np.int64), offs)
    dup = np.zeros(n_docs, np.int64)
    breaks = tk.per_doc_sum((data == 10).astype(np.int64), offs)
    for i in np.flatnonzero(breaks):
        seen = set()
        for line in data[offs[i]: offs[i + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\x0b\x0c\r"):
                dup[i] += line in seen
                seen.add(line)
    repeat = np.zeros(n_docs, np.int64)
    size = np.maximum(n_words - REPEAT_WINDOW + 1, 0)
    total = int(size.sum())
    if total:
        doc = np.repeat(np.arange(n_docs), size)
        pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(woff[:-1], size)
        key = np.zeros(total, np.uint64)
        for k in range(REPEAT_WINDOW):
            key = tk.mix64(key * _U(0x9E3779B97F4A7C15) + h[pos + k])
        key ^= tk.mix64(doc.astype(np.uint64) + _U(1))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            again = twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
            cover = np.zeros(len(h) + 1, np.int64)
            np.add.at(cover, pos[again], 1)
            np.add.at(cover, pos[again] + REPEAT_WINDOW, -1)
            repeat = tk.per_doc_sum((np.cumsum(cover[:-1]) > 0).astype(np.int64), woff)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


_SCORED = "doc_id {kind}, row long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_p double, n_chars long"


def _log_p(batch: pa.RecordBatch, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
    """Per text what a shard adds to its log probability, and its characters."""
    gram, high, offs = packed_ngrams(batch.column("text"))
    lens = np.diff(offs)
    langs = np.array([language_hash(l) for l in batch.column("lang").to_pylist()], np.uint64)
    return tk.per_doc_sum(log_probabilities(gram, high, np.repeat(langs, lens), shard), offs), lens


def _score_batch(shared):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = text_statistics(batch.column("text"))
        lp, lens = _log_p(batch, shared.value)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), batch.column("lang"), *(pa.array(v) for v in stats.values()),
             pa.array(lp), pa.array(lens)],
            names=["doc_id", "row", "lang", *stats, "log_p", "n_chars"])

    return run


def _add_batch(shared):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(_log_p(batch, shared.value)[0])], names=["row", "more"])

    return run


def quality(docs: DataFrame, fence: float = FENCE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, perplexity for every row of ``docs``."""
    shards = store(kneser_ney(persisted(count_ngrams(docs))))
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    many = len(shards) > 1
    row = F.monotonically_increasing_id() if many else F.lit(0).cast("long")
    rows = docs.select("doc_id", row.alias("row"), lang_key().alias("lang"), "text")
    if many:  # rows are numbered once, so that the shards' sums can be added
        rows = persisted(rows)
    scored = persisted(rows.mapInArrow(tk.map_slices(_score_batch(sc.broadcast(load(shards[0])))), _SCORED.format(kind=kind)))
    for shard in shards[1:]:
        more = rows.mapInArrow(tk.map_slices(_add_batch(sc.broadcast(load(shard)))), "row long, more double")
        scored = persisted(scored.join(more, "row").withColumn("log_p", F.col("log_p") + F.col("more")).drop("more"))
    means = scored.groupBy("lang").agg((F.sum("log_p") / F.greatest(F.sum("n_chars"), F.lit(1))).alias("mean"))
    drawn = -(F.col("log_p") + PRIOR_CHARS * F.col("mean")) / (F.col("n_chars") + PRIOR_CHARS)
    scored = scored.join(F.broadcast(means), "lang").withColumn("drawn", drawn)  # one row per language
    bands = (
        scored.where("n_chars > 0").groupBy("lang")
        .agg(F.percentile_approx("drawn", [0.25, 0.75], 10_000).alias("q"))
        .select("lang", (F.col("q")[0] - fence * (F.col("q")[1] - F.col("q")[0])).alias("low"),
                (F.col("q")[1] + fence * (F.col("q")[1] - F.col("q")[0])).alias("high"))
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.coalesce(F.col("drawn").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        scored.join(F.broadcast(bands), "lang", "left")
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                base.alias("base_failed"), (~base & inside).alias("kept"),
                F.when(F.col("n_chars") > 0, F.exp(-F.col("log_p") / F.col("n_chars"))).alias("perplexity"))
    )
