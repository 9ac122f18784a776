"""Benchmark decontamination with suffix arrays over the training documents.

Words: ASCII letters lower-cased; runs of ASCII letters, digits and non-ASCII
characters.  A window is ten consecutive words of one benchmark item; an item of one
to nine words is one window.

Every slice of documents is a shard.  A shard's words are replaced by codes of the
benchmark's vocabulary (0: not in it) and a suffix array of its word sequence is built;
suffixes that start with a pair of words that no item holds (or a word, for items of
one word) cannot match and are left out.  Every suffix of every item is then located in
the array by binary search; its occurrences mark the document words that are hit, and
each occurrence is extended to the longest verbatim match, of which the longest per
document is reported with its place.  Documents never move: a shard needs no shuffle.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, each sent to the
tasks by itself (a proven bound, some tens of MB); with more than one block the marks
of all blocks are united per document.

Special rows: a null or empty text has no word and no hit; a null item has no window;
items of equal text are all counted; repeated document rows give a row each; an empty
benchmark hits nothing; a null doc_id is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from custlens.llm import textkernel as tk
from custlens.llm.common import persisted

WINDOW = 10
BLOCK_WORDS = 1 << 20
_CODE_BITS = 21  # codes of a block's words; three fit a 63-bit key
_PACK = 3


@dataclass
class BenchmarkBlock:
    """Words of a block of items, with its vocabulary and distinct windows."""

    vocab: np.ndarray        # sorted word hashes; code = position + 1
    codes: np.ndarray        # codes of all item words, each item followed by WINDOW zeros
    starts: np.ndarray       # places in codes where a window starts, one per distinct window
    lengths: np.ndarray      # words of that window
    item_lists: list         # item ids of each distinct window
    pairs: np.ndarray        # sorted codes of word pairs that items hold
    singles: np.ndarray      # codes of the words of one-word items
    place_item: np.ndarray   # item id of each place in codes
    place_pos: np.ndarray    # word position within the item

    @staticmethod
    def of(rows) -> "BenchmarkBlock":
        ids = [r["item_id"] for r in rows]
        texts = pa.array([r["text"] for r in rows], pa.large_string())
        data, offs = tk.utf8(texts)
        h, woff, _, _ = tk.words(data, offs, tk.word_byte_table("alnum"))
        vocab = np.unique(h)
        code = np.searchsorted(vocab, h).astype(np.int64) + 1
        n = np.diff(woff)
        place = np.arange(len(code)) + np.repeat(np.arange(len(ids)) * WINDOW, n)
        codes = np.zeros(len(code) + len(ids) * WINDOW, np.int64)
        codes[place] = code
        place_item = np.full(len(codes), -1, np.int64)
        place_pos = np.zeros(len(codes), np.int64)
        item_index = np.repeat(np.arange(len(ids)), n)
        place_item[place] = item_index
        place_pos[place] = np.arange(len(code)) - np.repeat(woff[:-1], n)
        seen: dict[bytes, int] = {}
        starts, lengths, lists = [], [], []
        item_start = woff[:-1] + np.arange(len(ids)) * WINDOW
        for i in range(len(ids)):
            if not n[i]:
                continue
            size = int(min(n[i], WINDOW))
            for s in range(int(n[i]) - size + 1):
                at = int(item_start[i]) + s
                key = codes[at: at + size].tobytes()
                k = seen.get(key)
                if k is None:
                    seen[key] = k = len(starts)
                    starts.append(at)
                    lengths.append(size)
                    lists.append([])
                if not lists[k] or lists[k][-1] != ids[i]:
                    lists[k].append(ids[i])
        both = codes[:-1] * (codes[1:] > 0) * (codes[:-1] > 0)
        pairs = np.unique((both << _CODE_BITS | codes[1:])[both > 0])
        singles = np.unique(code[np.repeat(n == 1, n)])
        block = BenchmarkBlock(vocab, codes, np.array(starts, np.int64), np.array(lengths, np.int64), lists, pairs,
                               singles, place_item, place_pos)
        block.ids = ids
        return block


def _packs(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sort keys of the suffixes at ``at``: WINDOW words in packs of three codes.

    ``codes`` must have WINDOW entries beyond the last place.
    """
    keys = []
    for k in range(0, WINDOW, _PACK):
        key = np.zeros(len(at), np.int64)
        for j in range(_PACK):
            key <<= _CODE_BITS
            if k + j < WINDOW:
                key |= codes[at + k + j]
        keys.append(key)
    return keys


def _masks(length: np.ndarray) -> list[np.ndarray]:
    """For windows of ``length`` words: the bits of each pack that count."""
    out = []
    for k in range(0, WINDOW, _PACK):
        m = np.zeros(len(length), np.int64)
        for j in range(_PACK):
            m |= np.where(k + j < length, ((1 << _CODE_BITS) - 1) << (_CODE_BITS * (_PACK - 1 - j)), 0)
        out.append(m)
    return out


class SuffixArray:
    """Suffixes of a shard's code sequence, sorted by their first WINDOW words."""

    def __init__(self, codes: np.ndarray, at: np.ndarray):
        keys = _packs(codes, at)
        order = np.lexsort(keys[::-1])
        self.at = at[order]
        self.keys = [k[order] for k in keys]

    def find(self, query: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with the first ``length`` words of each query."""
        masks = _masks(length)
        low = [q & m for q, m in zip(query, masks)]
        high = [l | ~m & ((1 << (_CODE_BITS * _PACK)) - 1) for l, m in zip(low, masks)]
        return self._bound(low, False), self._bound(high, True)

    def _bound(self, query: list[np.ndarray], right: bool) -> np.ndarray:
        lo = np.zeros(len(query[0]), np.int64)
        hi = np.full(len(query[0]), len(self.at), np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = np.minimum((lo + hi) >> 1, max(len(self.at) - 1, 0))
            less = np.zeros(len(mid), bool)
            equal = np.ones(len(mid), bool)
            for k, q in zip(self.keys, query):
                v = k[mid]
                less |= equal & (v < q)
                equal &= v == q
            up = less | equal if right else less
            lo = np.where(open_ & up, mid + 1, lo)
            hi = np.where(open_ & ~up, mid, hi)


def _scan_shard(texts: pa.Array, block: BenchmarkBlock):
    """Per document: words, windows found (document, place, length, window) and longest matches."""
    data, offs = tk.utf8(texts)
    h, woff, _, _ = tk.words(data, offs, tk.word_byte_table("alnum"))
    n_docs = len(offs) - 1
    n_words = np.diff(woff)
    none = np.zeros(0, np.int64)
    if not len(h) or not len(block.vocab):
        return n_words, (none, none, none, none), None
    where = np.minimum(np.searchsorted(block.vocab, h), len(block.vocab) - 1)
    code = np.where(block.vocab[where] == h, where + 1, 0).astype(np.int64)
    # A zero after each document keeps matches inside it.
    doc_of = np.repeat(np.arange(n_docs), n_words)
    place = np.arange(len(code)) + doc_of
    codes = np.zeros(len(code) + n_docs + WINDOW, np.int64)
    codes[place] = code
    here = place[code > 0]
    pair = codes[here] << _CODE_BITS | codes[here + 1]
    keep = np.zeros(len(here), bool)
    if len(block.pairs):
        keep = block.pairs[np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)] == pair
    if len(block.singles):
        keep |= np.isin(codes[here], block.singles)
    array = SuffixArray(codes, here[keep])
    query = _packs(np.concatenate([block.codes, np.zeros(WINDOW, np.int64)]), block.starts)
    lo, hi = array.find(query, block.lengths)
    count = hi - lo
    window = np.repeat(np.arange(len(lo)), count)
    at = array.at[np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    ends = np.cumsum(n_words + 1)  # place of the zero after each document
    doc = np.searchsorted(ends, at, side="right")
    pos = at - (ends - n_words - 1)[doc]
    # Longest verbatim match from each occurrence on.
    length = block.lengths[window]
    source = block.starts[window]
    padded = np.concatenate([block.codes, np.zeros(1, np.int64)])
    grow = np.arange(len(at))
    while len(grow):
        a = codes[np.minimum(at[grow] + length[grow], len(codes) - 1)]
        b = padded[np.minimum(source[grow] + length[grow], len(padded) - 1)]
        grow = grow[(a == b) & (a > 0)]
        length[grow] += 1
    longest = None
    if len(at):
        order = np.lexsort((source, pos, -length, doc))
        head = order[np.concatenate([[True], doc[order][1:] != doc[order][:-1]])]
        longest = (doc[head], length[head], pos[head], source[head])
    return n_words, (doc, pos, block.lengths[window], window), longest


# After doc_id; documents and items keep the types of their ids.
_OUT = ["row", "n_words", "starts", "ends", "items", "longest", "longest_at", "longest_item", "longest_item_at"]


def _out_ddl(docs: DataFrame, benchmark: DataFrame) -> str:
    doc, item = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    return (f"doc_id {doc}, row long, n_words long, starts array<long>, ends array<long>, items array<{item}>, "
            f"longest long, longest_at long, longest_item {item}, longest_item_at long")



def _scan_batch(shared, kind: pa.DataType):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        block = shared.value
        n_words, (doc, pos, length, window), longest = _scan_shard(batch.column("text"), block)
        n = batch.num_rows
        starts, ends, items = [[]] * n, [[]] * n, [[]] * n
        best = [np.zeros(n, np.int64)] + [np.full(n, -1, np.int64) for _ in range(3)]
        if longest is not None:
            d, size, at, source = longest
            best[0][d], best[1][d] = size, at
            best[2][d], best[3][d] = block.place_item[source], block.place_pos[source]
            order = np.lexsort((pos, doc))
            doc, pos, length, window = doc[order], pos[order], length[order], window[order]
            heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for a, b in zip(heads, [*heads[1:], len(doc)]):
                # Union of the occurrences as disjoint word ranges.
                s, e = pos[a:b], np.maximum.accumulate(pos[a:b] + length[a:b])
                cut = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                i = int(doc[a])
                starts[i] = s[cut].tolist()
                ends[i] = e[np.concatenate([cut[1:] - 1, [len(e) - 1]])].tolist()
                found = set()
                for w in np.unique(window[a:b]):
                    found.update(block.item_lists[w])
                items[i] = sorted(x for x in found if x is not None)
        miss = best[1] < 0
        named = [None if m else block.ids[k] for m, k in zip(miss, best[2])]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("row"), pa.array(n_words),
            pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())),
            pa.array(items, pa.list_(kind)), pa.array(best[0]), pa.array(best[1], mask=miss),
            pa.array(named, kind), pa.array(best[3], mask=miss),
        ], names=["doc_id", *_OUT])

    return run


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS):
    """Yields the benchmark in blocks of about ``block_words`` words, in item order.

    Only one block is on the driver at a time.  Words are counted generously by the
    text's bytes, and a single item longer than a block is a block of its own.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) / 2 + 1
    sized = benchmark.select("item_id", "text", F.xxhash64("item_id").alias("h"), size.alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= block_words:
        rows = benchmark.select("item_id", "text").orderBy("item_id", "text").collect()
        yield BenchmarkBlock.of(rows)
        return
    # Hashed groups of about a sixteenth of a block, packed in order of their hash.
    groups = int(16 * total // block_words) + 1
    grouped = persisted(sized.withColumn("g", F.pmod("h", F.lit(groups))))
    per = grouped.groupBy("g").agg(F.sum("size").alias("size"))
    packed = per.withColumn("block", F.floor(F.sum("size").over(Window.orderBy("g")) / block_words).cast("int"))
    blocks = persisted(grouped.join(packed.select("g", "block"), "g"))
    for i in range(int(blocks.agg(F.max("block")).first()[0]) + 1):
        rows = blocks.where(F.col("block") == i).select("item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            yield BenchmarkBlock.of(rows)


def scan(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, row, n_words, the disjoint word ranges that are hit
    (``starts``, ``ends``), the ``items`` with occurring windows, and the longest match
    (``longest`` words at word ``longest_at``, from ``longest_item`` at ``longest_item_at``).
    """
    rows = docs.select("doc_id", F.lit(0).cast("long").alias("row"), "text")
    sc = docs.sparkSession.sparkContext
    ddl, kind = _out_ddl(docs, benchmark), to_arrow_type(benchmark.schema["item_id"].dataType)
    parts = []
    blocks = benchmark_blocks(benchmark, block_words)
    first = next(blocks, None)
    second = next(blocks, None)
    if second is not None:  # rows are numbered once, so that blocks can be united
        rows = persisted(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"))
    for block in filter(None, (first, second)):
        parts.append(rows.mapInArrow(tk.map_slices(_scan_batch(sc.broadcast(block), kind)), ddl))
    for block in blocks:
        parts.append(rows.mapInArrow(tk.map_slices(_scan_batch(sc.broadcast(block), kind)), ddl))
    if len(parts) == 1:
        return parts[0]
    hit = None
    for p in parts[1:]:
        found = p.where("size(starts) > 0")
        hit = found if hit is None else hit.unionByName(found)
    both = parts[0].unionByName(hit)
    best = F.max(F.struct("longest", (-F.col("longest_at")).alias("p"), "longest_item", "longest_item_at"))
    united = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
        F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), best.alias("best"))
    merged = F.aggregate(
        F.array_sort("ranges"), F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"),
        lambda acc, r: F.when((F.size(acc) > 0) & (r["starts"] <= F.element_at(acc, -1)["ends"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["starts"].alias("starts"),
                                  F.greatest(F.element_at(acc, -1)["ends"], r["ends"]).alias("ends")))))
        .otherwise(F.concat(acc, F.array(r))))
    return (
        united.withColumn("ranges", merged)
        .select("doc_id", "row", "n_words", F.col("ranges.starts").alias("starts"), F.col("ranges.ends").alias("ends"),
                "items", F.col("best.longest").alias("longest"), (-F.col("best.p")).alias("longest_at"),
                F.col("best.longest_item").alias("longest_item"), F.col("best.longest_item_at").alias("longest_item_at"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match."""
    hits = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return scan(docs, benchmark).select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"), "longest_at", "longest_item", "longest_item_at")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows in which a benchmark window occurs.

    Every block of the benchmark filters what the blocks before it left; no row moves.
    """
    sc = docs.sparkSession.sparkContext
    left = docs
    for block in benchmark_blocks(benchmark, block_words):
        shared = sc.broadcast(block)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            n_words, (doc, _, _, _), _ = _scan_shard(batch.column("text"), shared.value)
            clean = np.ones(len(n_words), bool)
            clean[doc] = False
            return batch.filter(pa.array(clean))

        left = left.mapInArrow(tk.map_slices(run), docs.schema)
    return left
