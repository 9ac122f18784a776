"""Small tables for the corpus operators, and comparison with DuckDB."""

from __future__ import annotations

import duckdb

from tools.compare import digest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    """documents from (doc_id, text) or full rows; fills lang, source and n_chars."""
    full = []
    for r in rows:
        r = tuple(r) + ("en", "src0")[len(r) - 2:] if len(r) < 4 else tuple(r)
        full.append((*r[:4], len(r[1]) if r[1] is not None else None))
    return spark.createDataFrame(full, DOCS)


def duck_matches(df, sql, **tables):
    """Whether a Spark result equals the SQL's over the given Arrow tables."""
    con = duckdb.connect()
    for name, t in tables.items():
        con.register(f"_{name}", t)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM _{name}")
    cur = con.execute(sql)
    want = digest([d[0] for d in cur.description], cur.fetchall())
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[2] == want[2], (sorted(set(got[3]) - set(want[3]))[:3], sorted(set(want[3]) - set(got[3]))[:3])


def sf_table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def duck_sf_matches(df, sql, *names):
    con = duckdb.connect()
    for n in names:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{SF}/{n}.parquet')")
    cur = con.execute(sql)
    want = digest([d[0] for d in cur.description], cur.fetchall())
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    assert got[:3] == want[:3], (sorted(set(got[3]) - set(want[3]))[:3], sorted(set(want[3]) - set(got[3]))[:3])


# Rows that every operator must take: null id, null and empty text, no letters, odd
# characters, repeated rows, a long text.
ODD = [
    (None, "a text without an id, of several words here"),
    (1, None, None, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "!!! ... ???"),
    (5, "日本語のテキスト и русский текст"),
    (6, "the same row twice in the table"),
    (6, "the same row twice in the table"),
    (7, "word " * 30_000),
    (8, "x" * 200_000),
    (9, "nul \x00 byte and \x01 too, é è ü ß"),
]
