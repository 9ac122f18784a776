"""Personal data: exact base patterns plus a character-level BiLSTM-CRF tagger.

Kinds: email, ip, card, phone.  The base finds the leftmost non-overlapping matches of
each kind's pattern and drops those that fail its check (parts of at most 255, Luhn,
number of digits), by scans that are linear in the text.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top
(nine labels: outside, and begin/inside of each kind), written in numpy and trained on
the driver by Adam on windows cut from labelled spans: the base spans of a bounded
sample of documents (``max_fit_docs``) and altered copies of them (other separators,
lost country code, spelled spacing), which teach forms the patterns do not reach.

Long texts are decoded in windows of ``WINDOW`` characters that overlap by half.  A
position takes its label from the window in whose middle half it lies, so every
position is decided once, and spans are then joined over the whole text.  Every span of
these kinds holds a digit or an ``@``; the tagger's spans without one are dropped, and a
window without one is outside throughout by definition, so it need not be decoded.
The result has all base spans and the tagger's spans that touch none of them.

Special rows: a null or empty text has no span; without any labelled span the tagger
adds none; repeated rows give a row each; a null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm import textkernel as tk
from custlens.llm.common import hashed_place, held_out, sample_by_hash

KINDS = ("email", "ip", "card", "phone")
MAX_FIT_DOCS = 400
WINDOW = 128
TRAIN_WINDOW = 72     # characters of a training window; the model itself has no length
TRAIN_STEPS = 360
HIDDEN = 16
EMBED = 12
CHARS = 256          # code points below 255; 255 stands for all others
LABELS = 1 + 2 * len(KINDS)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HAS_SIGN = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    """At each ``@``: the run of local characters before it, the domain after it.

    Whether a match exists at an ``@`` does not depend on where its local part begins,
    so looking at the signs one by one finds the leftmost matches in linear time.
    """
    at, done = text.find("@"), 0
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                done = domain.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches, by start, then kind."""
    if not text or not _HAS_SIGN.search(text):
        return []
    out = [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=_order)


def _order(span):
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def altered(text: str, spans, rng) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Copies of the text's spans in other spellings, with some context."""
    out = []
    for a, b, kind in spans:
        s = text[a:b]
        if kind == "email":
            forms = [s.replace("@", " @ "), s.replace("@", "(@)"), s.upper()]
        elif kind == "ip":
            forms = [s.replace(".", " . "), s.replace(".", "[.]")]
        elif kind == "card":
            digits = re.sub(r"\D", "", s)
            groups = [digits[i: i + 4] for i in range(0, len(digits), 4)]
            forms = [".".join(groups), "/".join(groups), "-".join(groups), " ".join(groups)]
        else:
            forms = [s.lstrip("+0123456789").strip() or s, s.replace(" ", "-"), "00" + s[1:]]
        form = forms[int(rng.integers(len(forms)))]
        left, right = text[max(0, a - 40): a], text[b: b + 40]
        out.append((left + form + right, [(len(left), len(left) + len(form), kind)]))
    return out


def encode(text: str) -> np.ndarray:
    """Character ids of a text."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), CHARS - 1).astype(np.int64)


def label_ids(n: int, spans) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _allowed() -> np.ndarray:
    """Penalty of transitions into an inside label that does not go on a span of its kind."""
    t = np.zeros((LABELS, LABELS), np.float32)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        t[:, inside] = -1e4
        t[inside - 1, inside] = t[inside, inside] = 0
    return t


class Tagger:
    """BiLSTM-CRF; arrays are time-major (steps, sequences, features)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"emb": init(CHARS, e) * 4, "out": init(2 * h, LABELS), "out_b": np.zeros(LABELS, np.float32),
                  "trans": np.zeros((LABELS, LABELS), np.float32), "start": np.zeros(LABELS, np.float32)}
        for d in "fb":
            self.p["wx" + d], self.p["wh" + d] = init(e, 4 * h), init(h, 4 * h)
            self.p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]).astype(np.float32)
        self.fixed = _allowed()

    def _lstm(self, x, d, keep):
        """Hidden states (steps, n, h); gates in order input, forget, cell, output."""
        p, h = self.p, HIDDEN
        steps, n = x.shape[:2]
        pre = x.reshape(-1, EMBED) @ p["wx" + d] + p["b" + d]
        pre = pre.reshape(steps, n, 4 * h)
        hs = np.zeros((steps, n, h), np.float32)
        saved = []
        hid = cell = np.zeros((n, h), np.float32)
        for t in range(steps):
            z = pre[t] + hid @ p["wh" + d]
            i, f, o = (_sigmoid(z[:, :h]), _sigmoid(z[:, h: 2 * h]), _sigmoid(z[:, 3 * h:]))
            g = np.tanh(z[:, 2 * h: 3 * h])
            before = cell
            cell = f * cell + i * g
            tc = np.tanh(cell)
            if keep:
                saved.append((i, f, g, o, before, tc, hid))
            hid = o * tc
            hs[t] = hid
        return hs, saved

    def emissions(self, ids, keep=False):
        """ids (steps, n) -> scores (steps, n, labels)."""
        x = self.p["emb"][ids]
        fwd, sf = self._lstm(x, "f", keep)
        bwd, sb = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([fwd, bwd[::-1]], axis=2)
        e = both.reshape(-1, 2 * HIDDEN) @ self.p["out"] + self.p["out_b"]
        return e.reshape(*ids.shape, LABELS), (x, sf, sb, both)

    def decode(self, ids) -> np.ndarray:
        """Best label sequences (Viterbi), (steps, n)."""
        e, _ = self.emissions(ids)
        steps, n = ids.shape
        trans = self.p["trans"] + self.fixed
        score = e[0] + self.p["start"] + self.fixed[0]
        back = np.zeros((steps, n, LABELS), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + trans
            back[t] = all_.argmax(axis=1)
            score = np.take_along_axis(all_, back[t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[t]
        y = np.zeros((steps, n), np.int64)
        y[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            y[t - 1] = back[t][np.arange(n), y[t]]
        return y

    def loss_and_grads(self, ids, y):
        """Mean negative log-likelihood per sequence and its gradients."""
        p = self.p
        e, (x, sf, sb, both) = self.emissions(ids, keep=True)
        steps, n = ids.shape
        # Forward-backward on probabilities, scaled to sum 1 at every step.
        trans = np.exp(p["trans"] + self.fixed)
        top = e.max(axis=2, keepdims=True)
        local = np.exp(e - top)
        alpha, beta = np.zeros_like(local), np.ones_like(local)
        scale = np.zeros((steps, n, 1), np.float32)
        for t in range(steps):
            a = (alpha[t - 1] @ trans if t else np.exp(p["start"] + self.fixed[0])) * local[t]
            scale[t] = a.sum(axis=1, keepdims=True)
            alpha[t] = a / scale[t]
        pulled = local / scale
        d_trans = np.zeros_like(trans)
        for t in range(steps - 1, 0, -1):
            w = pulled[t] * beta[t]
            d_trans += alpha[t - 1].T @ w
            beta[t - 1] = w @ trans.T
        d_trans *= trans
        de = alpha * beta
        log_z = np.log(scale).sum(axis=(0, 2)) + top.sum(axis=(0, 2))
        gold = p["start"][y[0]] + np.take_along_axis(e, y[:, :, None], 2).sum(axis=(0, 2))
        gold += (p["trans"] + self.fixed)[y[:-1], y[1:]].sum(axis=0)
        np.add.at(d_trans, (y[:-1].ravel(), y[1:].ravel()), -1)
        d_start = de[0].sum(axis=0) - np.bincount(y[0], minlength=LABELS)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        de /= n
        g = {"trans": (d_trans / n).astype(np.float32), "start": (d_start / n).astype(np.float32)}
        flat = de.reshape(-1, LABELS)
        g["out"] = both.reshape(-1, 2 * HIDDEN).T @ flat
        g["out_b"] = flat.sum(axis=0)
        d_both = (flat @ p["out"].T).reshape(steps, n, 2 * HIDDEN)
        dx = self._lstm_grads(x, sf, d_both[:, :, :HIDDEN], "f", g)
        dx += self._lstm_grads(x[::-1], sb, d_both[::-1, :, HIDDEN:], "b", g)[::-1]
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], ids.ravel(), dx.reshape(-1, EMBED))
        return float((log_z - gold).mean()), g

    def _lstm_grads(self, x, saved, d_hs, d, g):
        p, h = self.p, HIDDEN
        steps, n = x.shape[:2]
        dz_all = np.zeros((steps, n, 4 * h), np.float32)
        g["wh" + d] = np.zeros_like(p["wh" + d])
        d_hid = np.zeros((n, h), np.float32)
        d_cell = np.zeros((n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            i, f, gg, o, before, tc, hid_before = saved[t]
            dh = d_hs[t] + d_hid
            dc = d_cell + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :h] = dc * gg * i * (1 - i)
            dz[:, h: 2 * h] = dc * before * f * (1 - f)
            dz[:, 2 * h: 3 * h] = dc * i * (1 - gg * gg)
            dz[:, 3 * h:] = dh * tc * o * (1 - o)
            d_cell = dc * f
            d_hid = dz @ p["wh" + d].T
            g["wh" + d] += hid_before.T @ dz
        flat = dz_all.reshape(-1, 4 * h)
        g["wx" + d] = x.reshape(-1, EMBED).T @ flat
        g["b" + d] = flat.sum(axis=0)
        return (flat @ p["wx" + d].T).reshape(steps, n, EMBED)

    def train(self, ids, y, steps=TRAIN_STEPS, batch=64, rate=0.02, seed=11):
        """Adam over windows ids, y (windows, characters): ``steps`` random batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for step in range(1, steps + 1):
            part = rng.integers(0, len(ids), batch)
            _, g = self.loss_and_grads(ids[part].T, y[part].T)
            norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
            clip = min(1.0, 5.0 / (norm + 1e-9))
            lr = rate * (1 - step / (steps + 1))
            for k in self.p:
                q = g[k] * clip
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                self.p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def training_windows(texts: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows around labelled spans, their altered copies, and number-like text without a span."""
    rng = np.random.default_rng(seed)
    ids, labels = [], []

    def add(text, spans, a):
        part = encode(text[a: a + TRAIN_WINDOW])
        y = label_ids(len(text), spans)[a: a + TRAIN_WINDOW]
        pad = TRAIN_WINDOW - len(part)
        first = np.isin(y[:1], np.arange(2, LABELS, 2))
        if first.any():  # a span cut at the window's edge begins there
            y = y.copy()
            y[0] -= 1
        ids.append(np.concatenate([part, np.full(pad, 32)]))
        labels.append(np.concatenate([y, np.zeros(pad, np.int64)]))

    for text in texts:
        spans = base_spans(text)
        for a, b, _ in spans:
            add(text, spans, max(0, a - int(rng.integers(10, TRAIN_WINDOW - 30))))
        for other, marked in altered(text, spans, rng):
            add(other, marked, max(0, marked[0][0] - int(rng.integers(5, 40))))
        covered = np.zeros(len(text) + 1, bool)
        for a, b, _ in spans:
            covered[a:b] = True
        loose = [m.start() for m in re.finditer(r"[0-9@]+", text) if not covered[m.start()]]
        for a in loose[:: max(1, len(loose) // 4)][:4]:
            add(text, spans, max(0, a - int(rng.integers(0, TRAIN_WINDOW - 20))))
        add(text, spans, int(rng.integers(0, max(1, len(text) - TRAIN_WINDOW + 1))))
    if not ids:
        return np.zeros((0, TRAIN_WINDOW), np.int64), np.zeros((0, TRAIN_WINDOW), np.int64)
    return np.stack(ids), np.stack(labels)


def fit(docs: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Tagger | None:
    """A tagger trained on at most ``max_fit_docs`` documents that hold a digit or ``@``.

    The documents are those with the least hashed ids that are not held out.  A text gives
    4000 characters to training, around the first digits or ``@`` after a hashed place
    anywhere in it (prediction reads whole texts).
    """
    place = hashed_place(1)
    after = F.regexp_instr(F.substring("text", place, F.length("text")), F.lit(r"[0-9]{3}|@"))
    found = F.when(after > 0, place + after - 1).otherwise(F.regexp_instr("text", F.lit(r"[0-9]{3}|@")))
    near = F.greatest(found - 2000, F.lit(1))
    marked = docs.select("doc_id", "text").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"[0-9]{3}|@"))
    sample = sample_by_hash(marked, max_fit_docs, F.substring("text", near, F.lit(4000)).alias("text"))
    ids, y = training_windows(sorted(r["text"] for r in sample.collect()))
    if not (y > 0).any():
        return None
    tagger = Tagger()
    tagger.train(ids, y)
    return tagger


def tag(tagger: Tagger, texts: list[str], batch: int = 2048) -> list[list[tuple[int, int, str]]]:
    """Tagger spans of each text, from overlapping windows reconciled over the whole text."""
    half, quarter = WINDOW // 2, WINDOW // 4
    jobs = []  # (text, window start)
    chars = [encode(t) for t in texts]
    labels: list[np.ndarray | None] = [None] * len(texts)
    for i, c in enumerate(chars):
        sign = np.flatnonzero(((c >= 48) & (c <= 57)) | (c == 64))
        if not len(sign):
            continue
        labels[i] = np.zeros(len(c), np.int64)
        # Windows start at multiples of half a window, the first half a window early.
        last = sign // half
        jobs += [(i, int(k) * half - quarter) for k in np.unique(np.concatenate([last - 1, last, last + 1]))
                 if k >= 0 and int(k) * half - quarter < len(c)]
    for a in range(0, len(jobs), batch):
        part = jobs[a: a + batch]
        ids = np.full((len(part), WINDOW), 32, np.int64)
        for r, (i, s) in enumerate(part):
            lo, hi = max(s, 0), min(s + WINDOW, len(chars[i]))
            ids[r, lo - s: hi - s] = chars[i][lo:hi]
        signs = (((ids >= 48) & (ids <= 57)) | (ids == 64)).any(axis=1)
        y = np.zeros((len(part), WINDOW), np.int64)
        if signs.any():
            y[signs] = tagger.decode(np.ascontiguousarray(ids[signs].T)).T
        for r, (i, s) in enumerate(part):
            lo, hi = max(s + quarter, 0), min(s + quarter + half, len(chars[i]))
            if lo < hi:
                labels[i][lo:hi] = y[r, lo - s: hi - s]
    out = []
    for i, y in enumerate(labels):
        spans = []
        if y is not None and y.any():
            kind = (y + 1) // 2  # 0 outside, else 1 + kind
            # A span ends where the kind changes or another begins; where windows meet,
            # an inside label goes on the span of its kind before it.
            cut = np.flatnonzero((kind[1:] != kind[:-1]) | ((y[1:] % 2 == 1) & (kind[1:] > 0))) + 1
            edges = np.concatenate([[0], cut, [len(y)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if kind[a]:
                    a, b = int(a), int(b)
                    s = texts[i][a:b]
                    b = a + len(s.rstrip())
                    a += len(s) - len(s.lstrip())
                    if a < b and _plausible(texts[i][a:b], KINDS[kind[a] - 1]):
                        spans.append((a, b, KINDS[kind[a] - 1]))
        out.append(spans)
    return out


def _plausible(s: str, kind: str) -> bool:
    """What a tagged span must hold at least to count: the marks of its kind."""
    digits = sum("0" <= c <= "9" for c in s)
    if kind == "email":
        return "@" in s and len(s) > 3
    return digits >= {"ip": 4, "card": 12, "phone": 7}[kind]


def all_spans(texts: list[str | None], tagger: Tagger | None):
    """Per text: (base spans, all spans)."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    extra = tag(tagger, texts) if tagger is not None else [[] for _ in texts]
    out = []
    for b, more in zip(base, extra):
        clear = [s for s in more if all(s[1] <= a or s[0] >= e for a, e, _ in b)]
        out.append((b, sorted(b + clear, key=_order)))
    return out


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; n_added (tagger's spans).

    The counts are those of the base spans; ``spans`` lists all as kind:start:end.
    """
    tagger = tagger or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = all_spans(batch.column("text").to_pylist(), shared.value)
        counts = [pa.array([sum(k == kind for _, _, k in b) for b, _ in found], pa.int64()) for kind in KINDS]
        digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(digest), pa.array([joined(s) for _, s in found]),
             pa.array([len(s) - len(b) for b, s in found], pa.int64())], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        tk.map_slices(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, "
        "n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, n_added long")


def mask(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as ``[EMAIL]``.

    Where spans overlap, they are replaced together by the first one's kind.  ``n_chars``
    is counted anew where the table has it.  No row is dropped.
    """
    tagger = tagger or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    schema = docs.schema

    def cover(text, spans):
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        new = [t if not s else cover(t, s) for t, (_, s) in zip(texts, all_spans(texts, shared.value))]
        for i, (old, t) in enumerate(zip(texts, new)):
            # A span that is gone may have hidden another (digits of an address before a card).
            while t is not old and (left := base_spans(t)):
                t = new[i] = cover(t, left)
        cols = {n: batch.column(n) for n in batch.schema.names}
        cols["text"] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    masked = docs.mapInArrow(tk.map_slices(run), schema)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(kind)))
    return masked
