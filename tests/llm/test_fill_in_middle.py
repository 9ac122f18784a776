"""Fill-in-middle against the contract's pattern, and exact round trips through frames."""

from __future__ import annotations

import hashlib
import re

import pytest

from custlens.llm import fill_in_middle as fm
from custlens.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import ODD, SF, docs_frame, duck_sf_matches

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(doc_id, n, form, prefix_chars, middle_chars, output) straight from the definition."""
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return str(doc_id), n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return str(doc_id), n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def rows_of(docs, frame_bytes=fm.FRAME_BYTES):
    out = fm.fill_in_middle(fm.store_frames(docs, frame_bytes)).checkpoint()
    texts = sorted((str(r["doc_id"]), r["text"]) for r in fm.output_text(out).collect())
    back = sorted((str(r["doc_id"]), r["text"]) for r in fm.restored_text(out).collect())
    return fm.digests(out).collect(), texts, back


def check(rows, docs, frame_bytes=fm.FRAME_BYTES):
    got, texts, back = rows_of(docs, frame_bytes)
    want = sorted((plain(i, t) for i, t, *_ in rows), key=str)

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert texts == sorted((w[0], w[5]) for w in want)
    assert back == sorted((str(i), t or "") for i, t, *_ in rows)
    assert sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"]) for r in got), key=str) == sorted(
        ((*w[:5], sha(w[5])) for w in want), key=str)
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in got) == sorted((str(i), sha(t or "")) for i, t, *_ in rows)


def test_equals_sql_on_supplied_documents(spark):
    duck_sf_matches(QUERIES["op13_fill_in_middle"](spark, SF), ORACLE_SQL["op13_fill_in_middle"], "documents")


TEXTS = ["", " ", "a", " a", "a ", "  a\t b\n\n", "é è  ü", "日本 語 текст", "one<P>two", "x <M> y", "< P>", "<", "<S <P a <M", "P> S> M>",
         "a" * 50, "wide   " * 9 + "  ", "\x0b\x0c\r", "a b c", "tail <"]


@pytest.mark.parametrize("frame_bytes", [1, 2, 3, 7, 64, 1 << 16])
def test_cuts_at_any_frame_size(spark, frame_bytes):
    rows = [(i * len(TEXTS) + j, t) for i in range(4) for j, t in enumerate(TEXTS)]
    check(rows, docs_frame(spark, rows).repartition(3), frame_bytes)


def test_odd_rows_and_long_texts(spark):
    rows = ODD + [(i, ("word é  " * 40_000)[: 200_000 + i]) for i in range(20, 32)]
    check(rows, docs_frame(spark, rows))


def test_whole_frames_are_passed_on(spark):
    """A long text's output holds its inner frames as they were stored."""
    rows = [(i, " ".join(f"w{j}" for j in range(60_000))) for i in range(12)]
    stored = fm.store_frames(docs_frame(spark, rows))
    before = {r["doc_id"]: {bytes(f["data"]) for f in r["frames"]} for r in stored.collect()}
    out = [r for r in fm.fill_in_middle(stored).collect() if r["form"] != "plain"]
    assert out
    for r in out:
        after = {bytes(f["data"]) for f in r["frames"]}
        assert len(before[r["doc_id"]]) > 4 and len(before[r["doc_id"]] - after) <= 2


def test_string_ids_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([("k1", "some text to cut in parts", 1, "f", 2), (None, None, 1, "f", 2)],
                               "doc_id string, text string, n int, frames string, digest int")
    check([("k1", "some text to cut in parts"), (None, None)], df)
    check([], docs_frame(spark, []))
