"""Exact selection: the key at a given rank, without ordering the rows.

A rank's key is found by histograms: rows are counted per bucket of the key's range, the
bucket that holds the rank is cut into buckets again, and so on until few rows remain.  A
pass is one aggregation with a bounded number of groups, whatever the number of rows; no
row is moved or stored, and a value that very many rows share ends its key's search at
once, for all rows of a bucket then agree on it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Buckets of one pass, and rows that may be brought to the driver at the end of a search.
BUCKETS = 4096
FEW = 8192
_MOST = sys.float_info.max


def descending(col: str) -> list[Column]:
    """A number as two ascending columns (value, class): descending, nulls last.

    Numbers that are not finite share the extreme finite values; the class orders NaN
    (which Spark orders above all), infinity and the finite number there, and the finite
    number, minus infinity and null at the other end.
    """
    x = F.col(col).cast("double")
    finite = F.abs(x) < F.lit(float("inf"))
    kind = F.when(x.isNull(), 4).when(F.isnan(x), 0).when(finite, 2).when(x > 0, 1).otherwise(3)
    return [F.when(finite, 0.0 - x).otherwise(F.when(kind < 2, -_MOST).otherwise(_MOST)), kind]


def ascending_text(col: str) -> list[Column]:
    """A text as two ascending columns (absent, text): ascending, nulls last."""
    return [F.col(col).isNull().cast("int"), F.coalesce(F.col(col), F.lit(""))]


@dataclass
class _Search:
    """Where one rank's key lies: ``fixed`` leading columns, then an interval or a prefix."""

    order: int
    rank: int
    count: int = 0
    fixed: tuple = ()
    low: object = None
    high: object = None
    prefix: str = ""
    found: tuple | None = field(default=None)

    def state(self) -> tuple:
        return self.order, self.fixed, self.low, self.high, self.prefix


def _inside(columns: list[Column], s: _Search) -> Column:
    cond = F.lit(True)
    for c, v in zip(columns, s.fixed):
        cond = cond & (c == F.lit(v))
    if len(s.fixed) == len(columns):
        return cond
    c = columns[len(s.fixed)]
    if s.prefix:
        return cond & c.startswith(s.prefix)
    return cond if s.low is None else cond & c.between(F.lit(s.low), F.lit(s.high))


def _bucket(columns: list[Column], kinds: list[str], s: _Search) -> Column:
    """The bucket of a row in a search's next pass, in ascending order: a number and a text."""
    at = len(s.fixed)
    c, kind = columns[at], kinds[at]
    number, text = F.lit(0.0), F.lit("")
    if kind == "text":
        text = F.substring(c, 1, len(s.prefix) + 1)
    elif kind == "int":
        number = c.cast("double")
    elif s.low is not None:
        # The least and the greatest value never share a bucket, so every pass narrows.
        scale = 1.0 if math.isfinite(s.high - s.low) else 0.25
        share = (c * scale - F.lit(s.low * scale)) / F.lit(s.high * scale - s.low * scale)
        number = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("double")
    return F.struct(number.alias("number"), text.alias("text"))


def keys_at_ranks(df: DataFrame, orders: Sequence[list[Column]], kinds: Sequence[list[str]],
                  ranks: Sequence[list[int]]) -> list[list[tuple]]:
    """For each of several orders of ``df``, the keys at the given 1-based ranks.

    An order is a list of ascending, never-null columns that together tell rows apart;
    ``kinds`` names each ``int`` (few values), ``double`` or ``text``.
    """
    searches = [_Search(o, r) for o, rs in enumerate(ranks) for r in rs]
    while True:
        for s in searches:  # leading columns that are known end the search
            if s.found is None and len(s.fixed) == len(orders[s.order]):
                s.found = s.fixed
        live = [s for s in searches if s.found is None]
        if not live:
            break
        # The last rows of a search are fetched, all others counted in one pass.
        last = {s.state(): s for s in live if 0 < s.count <= FEW}
        if last:
            _fetch(df, last, live, orders)
        states = {s.state(): s for s in live if s.found is None}
        if states:
            _pass(df, list(states), states, [s for s in live if s.found is None], orders, kinds)
    done: list[list[tuple]] = [[] for _ in orders]
    for s in searches:
        done[s.order].append(s.found)
    return done


def _fetch(df, last, live, orders) -> None:
    """The few rows left of some searches, in one job."""
    flags = [F.when(_inside(orders[s.order], s), F.lit(i)) for i, s in enumerate(last.values())]
    columns = [c.alias(f"k{o}_{i}") for o, order in enumerate(orders) for i, c in enumerate(order)]
    hit = F.filter(F.array(*flags), lambda x: x.isNotNull()).alias("hit")
    rows = df.select(hit, *columns).where(F.size("hit") > 0).collect()
    for i, state in enumerate(last):
        o = state[0]
        mine = sorted(tuple(r[f"k{o}_{j}"] for j in range(len(orders[o]))) for r in rows if i in r["hit"])
        for s in live:
            if s.state() == state:
                s.found = mine[s.rank - 1]


def _pass(df, names, states, live, orders, kinds) -> None:
    """One aggregation: every search's rows per bucket, with the extremes of the bucket's
    own column and of the next two."""
    entries = []
    for i, name in enumerate(names):
        s = states[name]
        columns, kind, at = orders[s.order], kinds[s.order], len(s.fixed)
        numbers = [columns[i] if i < len(columns) and kind[i] != "text" else F.lit(0.0) for i in (at, at + 1, at + 2)]
        entry = F.struct(F.lit(i).alias("s"), _bucket(columns, kind, s).alias("b"),
                         *[x.cast("double").alias(f"v{j}") for j, x in enumerate(numbers)])
        entries.append(F.when(_inside(columns, s), entry))
    rows = (
        df.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).groupBy("e.s", "e.b")
        .agg(F.count(F.lit(1)).alias("n"), *[f(f"e.v{j}").alias(f"{n}{j}") for j in range(3) for f, n in ((F.min, "low"), (F.max, "high"))])
        .collect()
    )
    for i, name in enumerate(names):
        mine = sorted((r for r in rows if r["s"] == i), key=lambda r: (r["b"]["number"], r["b"]["text"].encode()))
        for s in live:
            if s.state() != name or s.found is not None:
                continue
            before = 0
            for r in mine:
                if s.rank <= before + r["n"]:
                    break
                before += r["n"]
            _narrow(s, r, before, kinds[s.order])


def _narrow(s: _Search, r, before: int, kinds: list[str]) -> None:
    """Moves a search into the bucket row ``r``, with ``before`` rows in front of it."""
    at = len(s.fixed)
    s.rank, s.count = s.rank - before, r["n"]
    text = r["b"]["text"]
    if kinds[at] == "text":
        if text != s.prefix:
            s.prefix = text  # of the texts that go on from here, the one that ends sorts first
            return
        s.fixed += (text,)
    elif r["low0"] < r["high0"]:
        s.low, s.high = r["low0"], r["high0"]
        return
    s.low, s.high, s.prefix = None, None, ""
    # The column is known, and those after it too as far as all rows agree.
    for j in range(3):
        if at + j >= len(kinds) or kinds[at + j] == "text":
            return
        if r[f"low{j}"] < r[f"high{j}"]:
            if kinds[at + j] == "double":
                s.low, s.high = r[f"low{j}"], r[f"high{j}"]
            return
        s.fixed += (int(r[f"low{j}"]) if kinds[at + j] == "int" else r[f"low{j}"],)


def at_or_before(columns: list[Column], key: tuple) -> Column:
    """Whether a row stands at or before ``key`` in the order of ``columns``."""
    struct = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])
    return struct <= F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(key)])
