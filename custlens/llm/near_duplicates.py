"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles (words: ASCII letters
lower-cased, digits, non-ASCII characters; a text of one to four words is one
shingle).  Two documents are linked when the weighted Jaccard similarity of their
multisets, ``sum(min) / sum(max)``, is at least 0.8; classes are the connected
components of the links.

* Signature.  Every shingle carries a Poisson process of darts on the plane
  (weight, rank), derived from its hash alone.  The weight axis is cut into regions
  [0,1), [1,2), [2,4), ...; a dart in a region hits a document when its weight lies
  below the shingle's count there.  Darts are thrown up to a rank that gives
  ``K ln K + 2K`` expected hits, each falls on one of K coordinates, and a coordinate
  keeps its earliest dart.  Documents with an empty coordinate throw on to twice the
  rank.  Two documents agree on a coordinate with probability equal to their weighted
  Jaccard similarity.
* Candidates.  Each band of 5 coordinates is a bucket key (24 bands: a pair at 0.8
  shares no band with probability 7e-5).  In a bucket every member is compared with two
  representatives; after the links found so far are merged into classes, buckets that
  still hold more than one class compare theirs with the member of most links and the
  one of fewest.  Work is linear in the bucket, and no row is copied into finer ones.
* Rest.  Texts in buckets of three or more that still hold more than one class go through an
  exact join, so a pair that met in a bucket is not lost because neither represented it.
  A text's tokens (shingle, occurrence) are put in one global order, rare ones first, and two
  texts at 0.8 share a token among the first ``n - ceil(0.8 n) + 1`` of each.  What two texts
  share lies at or after their first common token, so only token pairs whose places leave
  room for the similarity are joined: a text whose rare part is too long has no partner,
  and a passage that many unlike texts share lies behind every prefix.
* Check.  Each candidate pair is verified on the full shingle multisets.

Results for special rows: texts without a word (null, empty, punctuation only) form
a class of their own each; equal shingle sequences form one node, so copies are
linked without pairs; a null ``doc_id`` is kept as a row; repeated rows come out as
often as they came in.  Exactly one row of a class is kept, the first by (doc_id, nulls
last, row number), also where ids are null, repeated or shared with another class.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import broadcast_if_small, discard, persisted, with_free_names, written

SHINGLE = 5
MIN_SIMILARITY = 0.8
BANDS = 24
BAND_ROWS = 5
# First representatives follow this many independent document orders.
ORDERS = 3
# Token frequencies are counted in this many buckets; they only order the tokens.
FREQUENCY_BITS = 18
# Shingles of both sides that one step of the verification holds.
VERIFY_GRAMS = 1 << 20

_U = np.uint64
_LOW48 = _U((1 << 48) - 1)
_GOLD = _U(0x9E3779B97F4A7C15)


def _shingles(batch_texts: pa.Array):
    """(document index, 48-bit shingle hash) sorted, and two content hashes per document."""
    data, offs = tk.utf8(batch_texts)
    h, woff, _, _ = tk.words(data, offs, tk.word_byte_table("alnum"))
    n_docs = len(offs) - 1
    n_words = np.diff(woff)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    total = int(counts.sum())
    doc = np.repeat(np.arange(n_docs), counts)
    pos = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(woff[:-1], counts)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    left = np.repeat(woff[1:], counts) - pos
    mixed = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            word = padded[pos + k]
            word = np.where(k < left, word, _U(0)) if k else word
            mixed = tk.mix64(mixed * _GOLD + word)
    # Order-dependent content hashes: equal word sequences give equal nodes.
    with np.errstate(over="ignore"):
        place = np.arange(len(h)) - np.repeat(woff[:-1], n_words)
        seq = tk.mix64(h ^ tk.mix64(place.astype(np.uint64) + _U(1)))
        total_seq = np.concatenate([[_U(0)], np.cumsum(seq, dtype=np.uint64)])
        content = tk.mix64((total_seq[woff[1:]] - total_seq[woff[:-1]]) ^ (n_words.astype(np.uint64) * _GOLD))
    return doc, mixed & _LOW48, counts, content


def _throw(shingle, weight, limit, regions, coords):
    """All darts below ``limit`` that hit: (element index, rank, dart id, coordinate).

    ``limit`` is the rank bound of each element's document.  Within one region the
    ranks are the arrival times of a Poisson process whose rate is the region's width.
    """
    out = []
    for r in range(regions):
        low = 0 if r == 0 else 1 << (r - 1)
        width = 1 if r == 0 else low
        at = np.flatnonzero(weight > low) if r else np.arange(len(shingle))
        if not len(at):
            break
        seed = tk.mix64(shingle[at] ^ _U((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = np.zeros(len(at))
        bound = limit[at]
        while len(at):
            seed = tk.mix64(seed + _GOLD)
            # 53 random bits, never 0
            rank = rank - np.log(((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / width
            live = rank < bound
            at, seed, rank, bound = at[live], seed[live], rank[live], bound[live]
            dart = tk.mix64(seed ^ _U(0xD1B54A32D192ED03))
            hit = slice(None)
            if width > 1 or r:
                where = low + width * ((dart >> _U(11)).astype(np.float64) * 2.0 ** -53)
                hit = where < weight[at]
            out.append((at[hit], rank[hit], dart[hit]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0), np.zeros(0, np.uint64), z
    at, rank, dart = (np.concatenate(x) for x in zip(*out))
    coord = (tk.mix64(dart ^ _GOLD) % _U(coords)).astype(np.int64)
    return at, rank, dart, coord


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, coords: int) -> np.ndarray:
    """DartMinHash signatures (n_docs x coords, uint32) of weighted sets.

    Elements are given as parallel arrays; documents without an element get zeros.
    """
    sig = np.zeros((n_docs, coords), np.uint32)
    size = np.bincount(doc, weights=weight, minlength=n_docs)
    regions = 1 + max(0, int(weight.max()) - 1).bit_length() if len(weight) else 0
    darts = coords * math.log(coords) + 2 * coords
    open_docs = size > 0
    while open_docs.any():
        # A document's own bound depends on nothing but its size, so any batch gives the same result.
        bound = np.where(open_docs, darts / np.maximum(size, 1e-9), 0.0)
        use = np.flatnonzero(open_docs[doc])
        at, rank, dart, coord = _throw(shingle[use], weight[use], bound[doc[use]], regions, coords)
        cell = doc[use][at] * coords + coord
        best = np.full(n_docs * coords, np.inf)
        np.minimum.at(best, cell, rank)
        first = rank == best[cell]
        flat = np.zeros(n_docs * coords, np.uint32)
        flat[cell[first]] = (dart[first] >> _U(32)).astype(np.uint32)
        done = open_docs & ~np.isinf(best.reshape(n_docs, coords)).any(axis=1)
        sig[done] = flat.reshape(n_docs, coords)[done]
        open_docs = open_docs & ~done
        darts *= 2
    return sig


def _signature_batch(coords: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, shingle, counts, content = _shingles(batch.column("text"))
        n_docs = batch.num_rows
        shift = _U(48)
        parts = []
        # 16 bits for the document index beside the 48-bit hash: one sort groups equal shingles.
        for a in range(0, n_docs, 1 << 16):
            b = min(n_docs, a + (1 << 16))
            lo, hi = np.searchsorted(doc, [a, b])
            key = np.sort(((doc[lo:hi] - a).astype(np.uint64) << shift) | shingle[lo:hi])
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            weight = np.diff(np.concatenate([head, [len(key)]]))
            key = key[head]
            parts.append(signatures((key >> shift).astype(np.int64), key & _LOW48, weight.astype(np.int64), b - a, coords))
        sig = np.concatenate(parts) if parts else np.zeros((0, coords), np.uint32)
        none = counts == 0
        sigs = [None if none[i] else sig[i].tobytes() for i in range(n_docs)]
        node = pa.array(content.view(np.int64), mask=none)
        row = batch.column("_row") if "_row" in batch.schema.names else pa.nulls(n_docs, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), row, node, pa.array(counts), pa.array(sigs, pa.binary())],
            names=["doc_id", "_row", "node", "size", "sig"])

    return run


def sign(docs: DataFrame, coords: int = BANDS * BAND_ROWS) -> DataFrame:
    """doc_id, _row (if ``docs`` has it), node (content hash; null without words), size (shingles), sig (binary)."""
    return docs.select("doc_id", "text", *[c for c in docs.columns if c == "_row"]).mapInArrow(
        tk.map_slices(_signature_batch(coords)),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _row long, node long, size long, sig binary")


def _multiset_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    doc, shingle, counts, content = _shingles(batch.column("text"))
    ends = np.cumsum(counts)
    blobs = [np.sort(shingle[e - c: e] >> _U(16)).astype(np.uint32).tobytes() for e, c in zip(ends, counts)]
    return pa.RecordBatch.from_arrays(
        [pa.array(content.view(np.int64)), pa.array(blobs, pa.binary())],
        schema=pa.schema([("node", pa.int64()), ("grams", pa.binary())]))


def weighted_jaccard(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """sum(min)/sum(max) per pair of multisets of 32-bit shingles.

    Pair ``i`` has the parts of ``a`` and ``b`` up to its entries in ``ends_a`` and ``ends_b``.
    """
    def counted(grams, ends):
        pair = np.repeat(np.arange(len(ends), dtype=np.uint64), np.diff(np.concatenate([[0], ends])))
        return np.unique(pair << _U(32) | grams.astype(np.uint64), return_counts=True)

    (ua, ca), (ub, cb) = counted(a, ends_a), counted(b, ends_b)
    shared, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = np.bincount((shared >> _U(32)).astype(np.int64), weights=np.minimum(ca[ia], cb[ib]), minlength=len(ends_a))
    whole = np.diff(np.concatenate([[0], ends_a])) + np.diff(np.concatenate([[0], ends_b])) - both
    return np.where(whole > 0, both / np.maximum(whole, 1), 0.0)


def _blobs(column: pa.Array):
    """The shingles of a binary column, and where each row's end."""
    parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in column]
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64)


def _verify_batches(min_similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similar", pa.bool_())])

    def run(batches):
        for batch in batches:
            sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) // 4 for c in ("grams_a", "grams_b"))
            step = np.cumsum(sizes) // VERIFY_GRAMS
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                part = batch.slice(lo, hi - lo)
                ok = weighted_jaccard(*_blobs(part.column("grams_a")), *_blobs(part.column("grams_b"))) >= min_similarity
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok)], schema=schema)

    return run


def _band_key(band: int):
    """Bucket key of one band of coordinates."""
    parts = [F.expr(f"substring(sig, {4 * (band * BAND_ROWS + k) + 1}, 4)") for k in range(BAND_ROWS)]
    return F.xxhash64(F.lit(band), *parts)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per linked node.

    Alternates large-star and small-star steps (each node's larger, then smaller,
    neighbours are attached to its least neighbour).  The least neighbours are a table of
    their own, broadcast if few; else their join has plain shuffles on both sides, whose
    hot keys Spark splits.  Each step's table is removed when the next one is written.
    """
    state = written(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                    .where("lo <> hi").distinct(), "links")
    digest = None
    while True:
        both = state.selectExpr("lo as u", "hi as v").unionByName(state.selectExpr("hi as u", "lo as v"))
        near = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(both.where("v > u").join(broadcast_if_small(near), "u")
                        .select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "large")
        below = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "below")
        small = written(
            large.join(broadcast_if_small(below), "hi")
            .select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                                      F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))).alias("e"))
            .select("e.lo", "e.hi").where("lo <> hi").distinct(), "links")
        now = tuple(small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())
        for old in (state, near, large, below):
            discard(old)
        state = small
        if now == digest:
            break
        digest = now
    roots = state.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "node")
    found = written(roots.unionByName(state.selectExpr("lo as node", "lo as root").distinct()), "roots")
    discard(state)
    return found


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (node, root) with the classes that ``links`` (a, b) of nodes connect merged."""
    few = broadcast_if_small(classes)
    ends = (
        links.join(few.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        .join(few.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        .where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    moved = components(ends)
    out = written(
        classes.join(broadcast_if_small(moved.select(F.col("node").alias("root"), F.col("root").alias("onto"))), "root", "left")
        .select("node", F.coalesce("onto", "root").alias("root")), "classes")
    discard(moved)
    return out


def _broadcast_if_light(grams: DataFrame, max_bytes: int = 16 << 20) -> DataFrame:
    """The shingle multisets, to be broadcast if they measure at most ``max_bytes``; else
    they are shuffled to their pairs."""
    size = grams.agg(F.sum(F.length("grams") + 16)).first()[0] or 0
    return F.broadcast(grams) if size <= max_bytes else grams


def _verified(pairs: DataFrame, grams: DataFrame, min_similarity: float) -> DataFrame:
    """(a, b, similar) for pairs (a, b) of nodes."""
    both = (
        pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("grams_a")), "a")
        .join(grams.select(F.col("node").alias("b"), F.col("grams").alias("grams_b")), "b")
    )
    return both.mapInArrow(_verify_batches(min_similarity), "a long, b long, similar boolean")


def _count_grams(batches):
    """Per task: how many texts have a shingle in each frequency bucket."""
    counts = np.zeros(1 << FREQUENCY_BITS, np.int64)
    for batch in batches:
        for blob in batch.column("grams"):
            values = np.frombuffer(blob.as_buffer(), np.uint32) >> np.uint32(32 - FREQUENCY_BITS)
            counts[values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values] += 1
    seen = np.flatnonzero(counts)
    for a in range(0, len(seen), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(seen[a: a + 65536]), pa.array(counts[seen[a: a + 65536]])],
                                         names=["bucket", "n"])


def prefix(grams: np.ndarray, frequency: np.ndarray, min_similarity: float) -> np.ndarray:
    """The tokens (shingle << 32 | occurrence) that one of two similar texts must share:
    the first of the sorted multiset ``grams`` in the order (frequency, shingle, occurrence)."""
    n = len(grams)
    take = n - math.ceil(min_similarity * n - 1e-9) + 1
    head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    occurrence = np.arange(n) - np.repeat(head, np.diff(np.concatenate([head, [n]])))
    order = np.argsort(frequency[grams >> np.uint32(32 - FREQUENCY_BITS)], kind="stable")[:take]
    return (grams[order].astype(np.uint64) << _U(32) | occurrence[order].astype(np.uint64)).view(np.int64)


def _prefix_batches(shared, min_similarity: float):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                tokens = [prefix(np.frombuffer(g.as_buffer(), np.uint32), shared.value, min_similarity)
                          for g in part.column("grams")]
                counts = np.array([len(t) for t in tokens])
                at = pa.array(np.repeat(np.arange(part.num_rows), counts))
                place = np.concatenate([np.arange(c) for c in counts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), *(part.column(c).take(at) for c in ("node", "root", "size")),
                     pa.array(place)], names=["token", "node", "root", "size", "place"])

    return run


def _remaining_pairs(members: DataFrame, grams: DataFrame, min_similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes that can be similar, among the ``members`` (key, node,
    size, root) of buckets that still hold more than one class."""
    spark = members.sparkSession
    # Two members have met: one of them represented the bucket.
    still = written(members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("m"))
                    .where("lo <> hi AND m > 2").select("key"), "mixed")
    left = members.join(broadcast_if_small(still), "key", "left_semi").select("node", "size", "root").distinct()
    texts = written(grams.join(left, "node"), "texts")
    counted = texts.select("grams").mapInArrow(_count_grams, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toArrow()  # 2^FREQUENCY_BITS rows at most
    frequency = np.zeros(1 << FREQUENCY_BITS, np.int64)
    frequency[table["bucket"].to_numpy()] = table["n"].to_numpy()
    shared = spark.sparkContext.broadcast(frequency)
    spread = written(texts.mapInArrow(
        _prefix_batches(shared, min_similarity), "token long, node long, root long, size long, place long"), "prefixes")
    split = written(spread.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
                    .where("lo <> hi").select("token"), "shared")
    tokens = written(spread.join(broadcast_if_small(split), "token", "left_semi")
                     .select("token", "node", "root", "size", (F.col("size") - F.col("place")).alias("room")), "tokens")

    def can(a, b):
        """Whether sizes and places (of texts, or the widest of classes) allow the similarity.

        At the first token that two texts share, ``room`` is an upper bound of what they share.
        """
        return (F.least(a["most"], b["most"]) >= min_similarity * F.greatest(a["size"], b["size"])) & (
            F.least(a["room"], b["room"]) * (1 + min_similarity) + 1e-6 >= min_similarity * (a["size"] + b["size"]))

    # Classes meet first, so a large class costs nothing where it is alone; of two that meet, the one
    # with fewer texts at the token is copied.
    groups = written(tokens.groupBy("token", "root").agg(
        F.min("size").alias("size"), F.max("size").alias("most"), F.max("room").alias("room"), F.count(F.lit(1)).alias("n")), "groups")
    x, y = groups.alias("x"), groups.alias("y")
    fields = ("size", "most", "room")
    first, second = ({c: F.col(f"{t}.{c}") for c in fields} for t in "xy")
    meet = written(x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") < F.col("y.root")) & can(first, second))
                   .select("x.token", F.when(F.col("x.n") <= F.col("y.n"), F.struct(F.col("x.root").alias("root"), F.col("y.root").alias("other")))
                           .otherwise(F.struct(F.col("y.root").alias("root"), F.col("x.root").alias("other"))).alias("e"))
                   .select("token", "e.root", "e.other"), "meet")
    tokens_of = tokens.withColumn("most", F.col("size"))
    one = written(tokens_of.join(broadcast_if_small(meet), ["token", "root"]), "one")
    x, y = broadcast_if_small(one).alias("x"), tokens_of.alias("y")
    met = y.join(x, (F.col("x.token") == F.col("y.token")) & (F.col("x.other") == F.col("y.root")) & can(first, second))
    pairs = written(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    for old in (still, texts, spread, split, tokens, groups, meet, one):
        discard(old)
    return pairs


def _degrees(links: DataFrame) -> DataFrame:
    """(node, n_links) of the nodes that ``links`` (a, b) hold."""
    return links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))


def _grams_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, grams): the shingle multisets of the ``wanted`` nodes, of one text each."""
    ids = written(nodes.join(wanted, "node", "left_semi").select("rid").distinct(), "ids")
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("rid")), "left_semi")
    grams = written(texts.mapInArrow(tk.map_slices(_multiset_batch), "node long, grams binary")
                    .join(wanted, "node", "left_semi").dropDuplicates(["node"]), "grams")
    discard(ids)
    return grams


def find_links(docs: DataFrame, signed: DataFrame, min_similarity: float = MIN_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes (distinct texts), and (node, root) of the linked ones'
    classes; ``signed`` holds doc_id, node, size and the bucket ``keys``."""
    nodes = written(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rid"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    spread = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = written(spread.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
                     .where("lo <> hi").select("key"), "buckets")
    members = written(spread.join(broadcast_if_small(shared), "key", "left_semi"), "members")
    discard(shared)
    wanted = written(members.select("node").distinct(), "wanted")
    grams = _grams_of(docs, nodes, wanted)
    discard(nodes)
    light = _broadcast_if_light(grams)
    classes, tested = wanted.select("node", F.col("node").alias("root")), None
    used = [members, wanted, grams]

    def checked(pairs):
        """``pairs`` not tested yet, verified; the classes after it."""
        nonlocal tested, classes
        fresh = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        done = written(_verified(fresh, light, min_similarity), "tested")
        tested = done if tested is None else tested.unionByName(done)
        classes = _merged(classes, done.where("similar").select("a", "b"))
        used.extend([done, classes])

    for turn in range(2):
        rows = members
        if turn:
            rows = rows.join(broadcast_if_small(classes), "node")
            rows = rows.join(broadcast_if_small(_degrees(tested.where("similar"))), "node", "left")
        else:
            rows = rows.withColumns({"root": F.col("node"), "n_links": F.lit(None).cast("long")})
        # Turn 0: the least by two hashed orders.  Then the members of fewest and of most links.
        degree = F.coalesce("n_links", F.lit(0))
        rows = rows.withColumn("order", F.xxhash64(F.col("band") % ORDERS, "node"))
        who = F.struct("order", "node", "size", "root")
        picks = (F.min(F.struct(degree.alias("d"), who.alias("w"))), F.max(F.struct(degree.alias("d"), who.alias("w"))))
        reps = written(
            rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(*picks).alias("reps"))
            .where("lo <> hi").select("key", F.transform("reps", lambda r: r["w"]).alias("reps")), "reps")
        # Representatives of another class whose size allows the similarity.
        apt = F.filter("reps", lambda r: (r["root"] != F.col("root")) & (
            F.least("size", r["size"]) >= min_similarity * F.greatest("size", r["size"])))
        pairs = written(
            rows.join(broadcast_if_small(reps), "key").select("node", F.explode(apt).alias("r"))
            .select(F.least("node", "r.node").alias("a"), F.greatest("node", "r.node").alias("b")).distinct(), "pairs")
        checked(pairs)
        discard(reps)
        discard(pairs)
    pairs = _remaining_pairs(members.join(broadcast_if_small(classes), "node"), grams, min_similarity)
    checked(pairs)
    discard(pairs)
    links = written(tested.where("similar").select("a", "b"), "links")
    roots = written(classes.join(links.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "roots")
    for old in used:
        discard(old)
    return links, roots


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number that tells rows of the same doc_id (or without one) apart.

    It is null where the doc_id is the row's alone; only the other rows are stored with theirs.
    """
    shared = persisted(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
                       .select(F.col("doc_id").alias("shared_id")))
    if shared.isEmpty():
        return docs.withColumn("_row", F.lit(None).cast("long"))
    on = F.col("doc_id").eqNullSafe(F.col("shared_id"))
    few = broadcast_if_small(shared)
    numbered = persisted(docs.join(few, on, "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    return docs.join(few, on, "left_anti").withColumn("_row", F.lit(None).cast("long")).unionByName(numbered)


def _classed(docs: DataFrame, min_similarity: float) -> DataFrame:
    """doc_id, _row, class_id, class_size, n_links, keep per row of numbered ``docs``."""
    keys = F.when(F.col("sig").isNotNull(), F.array(*[_band_key(i) for i in range(BANDS)]))
    signed = written(sign(docs).select("doc_id", "_row", "node", "size", keys.alias("keys")), "signed")
    links, roots = find_links(docs, signed, min_similarity)
    linked = written(roots.join(_degrees(links), "node"), "linked")
    rows = signed.select("doc_id", "_row", "node").join(broadcast_if_small(linked), "node", "left")
    # A text without words is alone: its key is its own row.
    own = F.struct(F.coalesce("root", "node").alias("root"),
                   F.when(F.col("node").isNull(), F.monotonically_increasing_id()).alias("alone"))
    rows = written(rows.select("doc_id", "_row", own.alias("k"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
                   .select("doc_id", "_row", "k.root", "k.alone", "n_links"), "rows")
    for old in (signed, links, roots, linked):
        discard(old)
    with_words = rows.where("alone IS NULL")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    # Stored first, so that a hot class's rows are split in the join.
    classes = written(with_words.groupBy("root").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("class_size")), "classes")
    joined = with_words.join(broadcast_if_small(classes), "root").select(
        "doc_id", "_row", F.col("first.doc_id").alias("class_id"), "class_size", "n_links",
        place.eqNullSafe(F.col("first")).alias("keep"))
    alone = rows.where("alone IS NOT NULL").select("doc_id", "_row", F.col("doc_id").alias("class_id"),
                                                   F.lit(1).cast("long").alias("class_size"), "n_links", F.lit(True).alias("keep"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id, class_size, n_links, keep.

    ``class_id`` is the least doc_id of the class, ``class_size`` its number of rows,
    ``n_links`` the verified links of the row's text to other texts among the pairs that
    were tested, ``keep`` marks the one row of the class that stays.
    """
    return _classed(_numbered(docs.select("doc_id", "text")), min_similarity).drop("_row")


def drop_near_duplicates(docs: DataFrame, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the first by (doc_id, nulls last, row number).

    All columns are kept, whatever their names.
    """
    return with_free_names(docs, ("_row", "shared_id", "gone_id", "gone_row"), lambda rows: _dropped(rows, min_similarity))


def _dropped(docs: DataFrame, min_similarity: float) -> DataFrame:
    rows = _numbered(docs)
    gone = persisted(_classed(rows, min_similarity).where("NOT keep")
                     .select(F.col("doc_id").alias("gone_id"), F.col("_row").alias("gone_row")))
    here = F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.col("_row").eqNullSafe(F.col("gone_row"))
    return rows.join(broadcast_if_small(gone), here, "left_anti").select(*docs.columns)
