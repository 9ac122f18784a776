"""Vectorised text primitives that run inside Spark tasks on Arrow batches.

All functions take a string array and give flat numpy arrays plus per-document
offsets, so that a whole slice of documents is handled by a few array operations.
A null text counts as the empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Documents are handled in slices of about this many text bytes (a longer document
# is a slice of its own), which bounds the memory of the intermediate arrays.
SLICE_BYTES = 1 << 19

_U = np.uint64
_WORD_BASE = _U(0x9E3779B97F4A7C15)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_WORD_BASE, 1 << 16)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit integers (multiply and xor-shift rounds)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_byte_table(kind: str) -> np.ndarray:
    """256 entries: 0 where the byte separates words, else the byte to hash.

    ``alnum``: ASCII letters (lower-cased), digits and every non-ASCII byte form
    words.  ``space``: every byte but the space and the control characters 9-13.
    UTF-8 continuation bytes are non-ASCII, so working on bytes equals working on
    characters for both rules.
    """
    t = np.zeros(256, dtype=np.uint8)
    if kind == "alnum":
        t[128:] = np.arange(128, 256)
        t[48:58] = np.arange(48, 58)
        t[97:123] = np.arange(97, 123)
        t[65:91] = np.arange(97, 123)
    elif kind == "space":
        t[:] = np.arange(256)
        t[32] = 0
        t[9:14] = 0
        t[0] = 32  # a value that no other word byte has
    else:
        raise ValueError(kind)
    return t


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 document offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    if len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]: offs[-1]], offs - offs[0]


def code_points(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) of all texts and the n+1 document offsets into them."""
    if lower:
        texts = pc.utf8_lower(texts)
    data, offs = utf8(texts)
    first = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return cps, at[offs]


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray):
    """Word hashes of all documents.

    Returns ``(hashes, word_offsets, starts, ends)``: a 64-bit hash per word, the
    n+1 offsets of the documents into them, and each word's byte range.
    """
    mapped = table[data]
    inside = np.zeros(len(mapped) + 2, dtype=bool)
    inside[1:-1] = mapped != 0
    begins = inside[1:-1] & ~inside[:-2]
    finishes = inside[1:-1] & ~inside[2:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < len(mapped))]
    if len(edge):  # a word never runs from one document into the next
        begins[edge] |= inside[1:-1][edge]
        finishes[edge - 1] |= inside[1:-1][edge - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(finishes) + 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), starts, ends
    kept = mapped[inside[1:-1]]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(first, lens)
    part = _POW[place & 0xFFFF] * (kept.astype(np.uint64) + _U(1))
    if int(lens.max()) > 0xFFFF:  # positions beyond the table get another factor
        far = place > 0xFFFF
        part[far] *= mix64((place[far] >> 16).astype(np.uint64))
    hashes = mix64(np.add.reduceat(part, first) + lens.astype(np.uint64))
    return hashes, np.searchsorted(starts, offs).astype(np.int64), starts, ends


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` text bytes (or one row)."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + limit, side="right"))
        to = max(to, at + 1)
        yield at, to
        at = to


def map_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text_col: str = "text",
               limit: int = SLICE_BYTES):
    """A ``mapInArrow`` function that applies ``fn`` to slices of each batch."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            for a, b in slices(texts, limit):
                out = fn(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out

    return run


def per_doc_sum(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each document's range (0 for an empty range)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[offs[1:]] - total[offs[:-1]]
