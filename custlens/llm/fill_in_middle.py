"""Fill-in-middle transformation over seekable compressed frames.

A text is stored once as independent zstandard frames of at most ``FRAME_BYTES`` bytes,
cut between code points, each with the counts of units, code points and bytes that end
with it (cumulative).  From then on no step holds a whole text:

* ``store_frames``: one row per document with its frames and counts.
* ``fill_in_middle``: a binary search over the cumulative unit counts finds the two
  frames that hold the cuts; only these are decompressed, split and packed anew.  All
  other frames pass into the output as they are, in the output's order.
* ``digests``: streams the output's frames in order for its digest, finds the marks on
  the way, then seeks the three parts in the text's order for the digest of the
  restored text.  ``output_text`` and ``restored_text`` give the texts themselves.

A unit is ``[ws]*[non-ws]+`` or, at the end of a text, ``[ws]+`` (white space: the space
and the control characters 9 to 13).  Cuts and form come from the hex sha256 of
``<seed>:<doc_id>``.

Results for special rows: a null or empty text has no unit, no frame, form ``plain`` and
the digests of the empty text; a text that holds one of the marks stays plain; a null
doc_id counts as the empty string in the hash; repeated rows come out as often as they
came in; ids keep their type; further columns, whatever their names, are not read.
A text of any length is cut into frames of the same size.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, BooleanType, LongType, StringType, StructField,
                               StructType)

from custlens.llm import textkernel as tk

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
# The parts of an output in its order, each after its mark.
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
FRAME_BYTES = 1 << 16
LEVEL = 1

_WORD = re.compile(rb"[^ \t-\r]+")
_SPACE = frozenset(b" \t\n\x0b\x0c\r")

_FRAMES = ArrayType(StructType([
    StructField("units", LongType()), StructField("chars", LongType()), StructField("bytes", LongType()),
    StructField("data", BinaryType())]))
_ARROW_FRAMES = pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))


def _n_chars(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def inner_ends(data: bytes) -> list[int]:
    """Ends of the units of a frame that end before its last byte."""
    return [m.end() for m in _WORD.finditer(data) if m.end() < len(data)]


def cut_frames(text: bytes, frame_bytes: int, pack) -> list[tuple[int, int, int, bytes]]:
    """The frames of a text: (units, chars, bytes) up to its end, and its packed bytes."""
    out, units, chars, at = [], 0, 0, 0
    while at < len(text):
        to = min(at + frame_bytes, len(text))
        while to < len(text) and text[to] & 0xC0 == 0x80:  # never inside a code point
            to += 1
        data = text[at:to]
        units += len(inner_ends(data))
        # The frame's end ends a unit if a word or the whole text stops there.
        units += to == len(text) or (data[-1] not in _SPACE and text[to] in _SPACE)
        chars += _n_chars(data)
        out.append((units, chars, to, pack(data)))
        at = to
    return out


class Frames:
    """Random access to the bytes of a text by its frames; one unpacked frame is held."""

    def __init__(self, ends: list[int], packed: list[bytes], unpack) -> None:
        self.ends, self.packed, self._unpack, self._held = ends, packed, unpack, (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, self._unpack(self.packed[k]))
        return self._held[1]

    def read(self, start: int, end: int):
        """Pieces of the bytes from ``start`` to ``end``."""
        k = bisect.bisect_right(self.ends, start)
        while start < end:
            base = self.ends[k - 1] if k else 0
            piece = self.frame(k)[start - base: end - base]
            yield piece
            start += len(piece)
            k += 1


def locate(frames: Frames, units: list[int], k: int) -> int:
    """The byte where the first ``k`` units of a text end."""
    if k == 0:
        return 0
    f = bisect.bisect_left(units, k)
    inside = inner_ends(frames.frame(f))
    nth = k - (units[f - 1] if f else 0)
    base = frames.ends[f - 1] if f else 0
    return base + inside[nth - 1] if nth <= len(inside) else frames.ends[f]


def _arrange(frames: Frames, parts: dict[str, tuple[int, int]], form: str, pack):
    """Packed frames of the output, with their sizes: whole frames of the text as they
    are; marks and cut frames in new ones."""
    loose: list[bytes] = []
    for name in ORDERS[form]:
        start, end = parts[name]
        loose.append(MARKS[name])
        k = bisect.bisect_right(frames.ends, start)
        while start < end:
            base, stop = (frames.ends[k - 1] if k else 0), frames.ends[k]
            if start == base and stop <= end and stop - base >= 1024:
                if loose:
                    data = b"".join(loose)
                    yield len(data), pack(data)
                    loose = []
                yield stop - base, frames.packed[k]
            else:
                loose.append(frames.frame(k)[start - base: end - base])
            start = min(stop, end)
            k += 1
    if loose:
        data = b"".join(loose)
        yield len(data), pack(data)


def find_marks(frames: Frames) -> dict[str, int]:
    """Where each mark stands in an output, read frame by frame."""
    found, tail, at = {}, b"", 0
    for k in range(len(frames.ends)):
        data = tail + frames.frame(k)
        for name, mark in MARKS.items():
            if name not in found and (p := data.find(mark)) >= 0:
                found[name] = at - len(tail) + p
        at = frames.ends[k]
        tail = data[-2:]
    return found


def restored(frames: Frames, form: str):
    """Pieces of the exact text, from the output's frames and the form alone."""
    size = frames.ends[-1] if frames.ends else 0
    if form == "plain":
        yield from frames.read(0, size)
        return
    marks = find_marks(frames)
    order = ORDERS[form]
    ends = {name: marks[after] for name, after in zip(order, order[1:])} | {order[-1]: size}
    for name in ("prefix", "middle", "suffix"):
        yield from frames.read(marks[name] + len(MARKS[name]), ends[name])


def _frame_lists(rows: list[list[tuple]]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    flat = [f for r in rows for f in r]
    columns = [pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=["units", "chars", "bytes", "data"]))


def _unlisted(column: pa.Array):
    """(units, chars, bytes, data) lists of each row of a frames column."""
    for frames in column:
        rows = frames.as_py() or []
        yield [f["units"] for f in rows], [f["chars"] for f in rows], [f["bytes"] for f in rows], [f["data"] for f in rows]


def _codec():
    """Packing and unpacking of frames: a few bytes of header, no checksum of its own."""
    c = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=True)
    d = zstandard.ZstdDecompressor()
    return c.compress, d.decompress


def store_frames(docs: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """doc_id, n (units), n_chars, marked (a mark stands in the text), frames."""
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("n", LongType()), StructField("n_chars", LongType()),
                         StructField("marked", BooleanType()), StructField("frames", _FRAMES)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack, _ = _codec()
        data, offs = tk.utf8(batch.column("text"))
        rows, marked = [], []
        for a, b in zip(offs[:-1], offs[1:]):
            text = data[a:b].tobytes()
            marked.append(any(m in text for m in MARKS.values()))
            rows.append(cut_frames(text, frame_bytes, pack))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[-1][0] if r else 0 for r in rows], pa.int64()),
             pa.array([r[-1][1] if r else 0 for r in rows], pa.int64()), pa.array(marked, pa.bool_()), _frame_lists(rows)],
            names=["doc_id", "n", "n_chars", "marked", "frames"])

    return docs.select("doc_id", "text").mapInArrow(tk.map_slices(run), schema)


def fill_in_middle(stored: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and the output's frames."""
    id_type = stored.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), StructField("n", LongType()), StructField("form", StringType()),
                         StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()),
                         StructField("frames", _FRAMES)])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = (F.col("n") == 0) | F.col("marked") | (h[2] % 100 >= fim_percent)
    cuts = [h[i] % (F.col("n") + 1) for i in range(2)]
    planned = stored.withColumn("digest", digest).select(
        "doc_id", "n", "frames",
        F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
        F.least(*cuts).alias("first"), F.greatest(*cuts).alias("last"))

    def run(batches):
        pack, unpack = _codec()
        for batch in batches:
            forms, first, last = (batch.column(c).to_pylist() for c in ("form", "first", "last"))
            prefix, middle, rows = [], [], []
            for i, (units, chars, ends, packed) in enumerate(_unlisted(batch.column("frames"))):
                if forms[i] == "plain":
                    prefix.append(None)
                    middle.append(None)
                    rows.append([(None, None, e, p) for e, p in zip(ends, packed)])
                    continue
                frames = Frames(ends, packed, unpack)
                cut = [locate(frames, units, k) for k in (first[i], last[i])]
                before = []
                for at in cut:
                    k = bisect.bisect_right(ends, at)
                    base, known = (ends[k - 1], chars[k - 1]) if k else (0, 0)
                    before.append(known + (_n_chars(frames.frame(k)[: at - base]) if at > base else 0))
                prefix.append(before[0])
                middle.append(before[1] - before[0])
                parts = {"prefix": (0, cut[0]), "middle": (cut[0], cut[1]), "suffix": (cut[1], ends[-1])}
                row, at = [], 0
                for size, data in _arrange(frames, parts, forms[i], pack):
                    at += size
                    row.append((None, None, at, data))
                rows.append(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n"), batch.column("form"), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), _frame_lists(rows)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"])

    return planned.mapInArrow(run, schema)


def _output_frames(batch: pa.RecordBatch):
    _, unpack = _codec()
    for form, (_, _, ends, packed) in zip(batch.column("form").to_pylist(), _unlisted(batch.column("frames"))):
        yield form, Frames(ends, packed, unpack)


def digests(outputs: DataFrame) -> DataFrame:
    """``outputs`` without their frames, with output_sha256 and restored_sha256."""
    kept = [f for f in outputs.schema.fields if f.name not in ("frames", "output_sha256", "restored_sha256")]
    schema = StructType(kept + [StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])

    def run(batches):
        for batch in batches:
            both = [], []
            for form, frames in _output_frames(batch):
                out, back = hashlib.sha256(), hashlib.sha256()
                for k in range(len(frames.ends)):
                    out.update(frames.frame(k))
                for piece in restored(frames, form):
                    back.update(piece)
                both[0].append(out.hexdigest())
                both[1].append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept] + [pa.array(x, pa.string()) for x in both], names=schema.names)

    return outputs.mapInArrow(run, schema)


def _texts(outputs: DataFrame, pieces) -> DataFrame:
    schema = StructType([outputs.schema["doc_id"], StructField("text", StringType())])

    def run(batches):
        for batch in batches:
            texts = [b"".join(pieces(frames, form)).decode("utf-8", "replace") for form, frames in _output_frames(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return outputs.mapInArrow(run, schema)


def output_text(outputs: DataFrame) -> DataFrame:
    """doc_id, text: the outputs as training texts (here a whole text is held at a time)."""
    return _texts(outputs, lambda frames, form: frames.read(0, frames.ends[-1] if frames.ends else 0))


def restored_text(outputs: DataFrame) -> DataFrame:
    """doc_id, text: the exact texts, rebuilt from the outputs and their forms."""
    return _texts(outputs, restored)


def oracle_sql(seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> str:
    """The query's rows over ``documents`` in DuckDB SQL."""
    h = ", ".join(f"('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    return rf"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, {h},
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
planned AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN len(u) = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim_percent} THEN 'plain'
         WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM planned)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
