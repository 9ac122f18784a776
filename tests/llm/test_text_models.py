"""Toxicity, language, quality classifier and quality rules."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from custlens.llm import language_id, quality_classifier, quality_rules, toxicity
from custlens.llm.common import held_out
from tests.llm.helpers import ODD, docs_frame


def _words(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


def _toxic_table(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = _words(rng, "abcdeost", rng.randint(20, 120))
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zgrumpf", "kwarxel"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = _toxic_table(spark)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 400
    held = [r for r in out if r["held_out"]]
    assert 40 < len(held) < 130
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == {r["doc_id"] for r in out if r["score"] < 0.5}


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = docs_frame(spark, ODD).withColumn("toxic", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, none).collect()
    assert len(out) == len(ODD) and {r["predicted"] for r in out} <= {0, 1}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    one_class = spark.createDataFrame([(4, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, one_class).collect()} == {0}


def test_ngrams_are_those_of_each_text():
    texts = ["abcde", None, "ab", "abcdé abcdé", "ABCDE"]
    whole, offs = toxicity.features(pa.array(texts))
    for i, t in enumerate(texts):
        own, _ = toxicity.features(pa.array([t], pa.string()))
        assert (whole[offs[i]: offs[i + 1]] == own).all()
    assert np.diff(offs).tolist() == [6, 0, 0, 3 * 9 - 3 - (9 + 8 + 7) + len(toxicity.features(pa.array(["abcdé abcdé"]))[0]), 6]


LETTERS = {"aa": "abcdef", "bb": "ghijkl", "cc": "mnopqr"}


def _language_table(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        lang = sorted(LETTERS)[i % 3]
        rows.append((i, " ".join(_words(rng, LETTERS[lang] + "stu", rng.randint(5, 60))), lang, "s"))
    return docs_frame(spark, rows)


def test_language_on_held_out_documents(spark):
    docs = _language_table(spark)
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    held = [r for r in out.values() if r["held_out"]]
    assert sum(r["lang_pred"] == sorted(LETTERS)[r["doc_id"] % 3] for r in held) >= 0.97 * len(held)


def test_switched_text_is_labelled_word_by_word(spark):
    field = language_id.fit(_language_table(spark))
    rng = random.Random(9)
    a, b = _words(rng, LETTERS["aa"], 30), _words(rng, LETTERS["bb"], 30)
    texts = pa.array([" ".join(a + b)])
    w = language_id.split_words(texts)
    e = field.emissions(w).astype(float)
    post = field.posteriors(np.exp(e - e.max(axis=1, keepdims=True))[w.of], w.offs)
    best = post.argmax(axis=1)
    assert (best[:30] == 0).mean() > 0.9 and (best[30:] == 1).mean() > 0.9
    assert np.allclose(post.sum(axis=1), 1)


def test_chunked_chains_equal_the_plain_algorithm():
    rng = np.random.default_rng(0)
    f = language_id.Field(["a", "b", "c"], None, None, 1.0, np.zeros(3), rng.normal(size=(3, 3)))
    offs = np.array([0, 5, 5, 400, 401, 900])
    local = np.exp(rng.normal(size=(900, 3)))
    got = f.posteriors(local.copy(), offs)
    move = np.exp(f.transitions)
    for a, b in zip(offs[:-1], offs[1:]):
        alpha, x = [], np.ones(3)
        for t in range(a, b):
            x = (x @ move) * local[t]
            x /= x.sum()
            alpha.append(x)
        y = np.ones(3)
        for t in range(b - 1, a - 1, -1):
            p = alpha[t - a] * y
            assert np.allclose(p / p.sum(), got[t])
            y = move @ (local[t] * y)
            y /= y.sum()


def test_language_odd_rows(spark):
    docs = docs_frame(spark, ODD)
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert out[7]["lang_pred"] == "en" and language_id.identify(docs).count() == len(ODD)
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    votes = np.full((20_000, 9), -1)
    for k in range(9):
        speak = rng.random(20_000) < 0.6
        right = rng.random(20_000) < 0.75 + 0.02 * k
        votes[:, k] = np.where(speak, np.where(right, good, ~good), -1)
    code, count = np.unique(quality_classifier.pattern(votes), return_counts=True)
    model = quality_classifier.expectation_maximisation(quality_classifier.unpack(code), count.astype(float))
    assert ((model.log_odds(votes) > 0) == good).mean() > 0.9
    assert abs(model.good - 0.8) < 0.08


def test_quality_classifier_rejects_junk(spark):
    rng = random.Random(6)
    sentence = lambda: " ".join(_words(rng, "abcdefgost", rng.randint(6, 14))).capitalize() + "."
    rows = []
    for i in range(200):
        text = " ".join(sentence() for _ in range(12))
        if i % 8 == 1:
            text = text.upper().replace(" ", "!! ")
        elif i % 8 == 3:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text))
    out = quality_classifier.quality_scores(docs_frame(spark, rows)).collect()
    junk = [r for r in out if r["doc_id"] % 8 in (1, 3)]
    assert all(not r["kept"] for r in junk)
    assert all(r["kept"] for r in out if r["doc_id"] % 8 not in (1, 3))
    odd = quality_classifier.quality_scores(docs_frame(spark, ODD).withColumn("score", F.lit(0.5))).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier.quality_scores(docs_frame(spark, rows).limit(0)).count() == 0


def _brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i: i + 5])] > 1:
            inside.update(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_text_statistics_equal_plain_python(spark):
    rng = random.Random(8)
    texts = [r[1] for r in ODD[:8]] + [
        "".join(rng.choice(["a", "b", "a b ", "é", " ", "\n", "\t", "#", "|", "x y z x y z x\n", "\x00", " "])
                for _ in range(rng.randint(0, 80))) for _ in range(300)]
    got = quality_rules.text_statistics(pa.array(texts, pa.string()))
    rows = list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert rows == [_brute_statistics(t) for t in texts]


def _plain_kneser_ney(texts):
    """Interpolated modified Kneser-Ney over characters, in plain Python; None: unseen."""
    top = Counter()
    for t in texts:
        s = "\x00" * 3 + t
        for i in range(3, len(s)):
            top[s[i - 3: i + 1]] += 1
    tables = [top]
    for _ in range(3):
        tables.insert(0, Counter(g[1:] for g in tables[0]))
    probs: list[dict] = []
    for order, grams in enumerate(tables, start=1):
        n = [sum(c == k for c in grams.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0

        def d(c, n=n, y=y):
            k = min(c, 3)
            if n[k] and n[1]:
                return min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k)
            return (0.5, 0.75, 0.9)[k - 1]

        total, left, types = Counter(), Counter(), Counter()
        for g, c in grams.items():
            total[g[:-1]] += c
            left[g[:-1]] += d(c)
            types[g[:-1]] += 1
        own = {}
        for g, c in grams.items():
            ctx = g[:-1]
            lower = probs[-1][g[1:]] if order > 1 else 1 / (types[ctx] + 1)
            own[g] = (c - d(c)) / total[ctx] + left[ctx] / total[ctx] * lower
        probs.append(own)
    return tables, probs


def test_model_equals_plain_kneser_ney(spark):
    rng = random.Random(4)
    texts = [" ".join(_words(rng, "abcde", 8)) for _ in range(40)]
    docs = docs_frame(spark, [(i, t) for i, t in enumerate(texts)])
    levels = quality_rules.kneser_ney(quality_rules.count_ngrams(docs))
    tables, probs = _plain_kneser_ney(texts)

    def unpack(g, order):
        out = []
        for _ in range(order):
            c = g & quality_rules._MASK
            out.append(chr(c - 1) if c else "\x00")
            g >>= quality_rules.CHAR_BITS
        return "".join(reversed(out))

    for order, level in enumerate(levels, start=1):
        got = {unpack(r["gram"], order): r["p"] for r in level.where("n > 0").collect()}
        assert set(got) == set(tables[order - 1])
        assert all(abs(got[g] - probs[order - 1][g]) < 1e-9 for g in got)


def test_scores_are_those_of_the_whole_model(spark, monkeypatch):
    rng = random.Random(8)
    signs = [chr(c) for c in (97, 98, 32768 + 97, 32767 + 97, 0x9FA5, 0x1F600, 0x1F600 - 32767)]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(30, 60))) for _ in range(40)]
    tables, probs = _plain_kneser_ney(texts)
    want = {}
    for i, t in enumerate(texts):
        s, total = "\x00" * 3 + t, 0.0
        for k in range(3, len(s)):
            g = s[k - 3: k + 1]
            p = probs[3][g]
            if tables[3][g] == 1:  # as unseen: what the context leaves to the shorter n-gram
                same = [c for x, c in tables[3].items() if x[:3] == g[:3]]
                p -= (1 - _first_discount(tables[3])) / sum(same)
            total += np.log(p)
        want[i] = np.exp(-total / len(t))
    docs = docs_frame(spark, list(enumerate(texts)))
    for entries in (4_000_000, 400):  # one shard, several shards
        monkeypatch.setattr(quality_rules, "SHARD_ENTRIES", entries)
        got = {r["doc_id"]: r["perplexity"] for r in quality_rules.quality(docs).collect()}
        assert all(abs(got[i] / want[i] - 1) < 1e-4 for i in want) and len(got) == len(want)


def _first_discount(grams):
    n1, n2 = (sum(c == k for c in grams.values()) for k in (1, 2))
    return min(max(1 - 2 * n1 / (n1 + 2 * n2) * n2 / n1, 0.05), 1) if n2 else 1.0


def test_quality_rules_bands_and_base(spark):
    rng = random.Random(7)
    vocabulary = _words(rng, "abcdefghij", 300)
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 90)))) for i in range(300)]
    rows += [(1000, " ".join(_words(rng, "QWXZ987", 80))), (1001, "one two three"), (1002, "again and over again now " * 20)]
    out = {r["doc_id"]: r for r in quality_rules.quality(docs_frame(spark, rows)).collect()}
    assert not out[1000]["base_failed"] and not out[1000]["kept"]
    assert out[1001]["base_failed"] and out[1002]["base_failed"]
    clean = [r for i, r in out.items() if i < 300]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    odd = quality_rules.quality(docs_frame(spark, ODD).withColumn("kept", F.lit(1))).collect()
    assert len(odd) == len(ODD) and not any(r["kept"] for r in odd if r["doc_id"] in (1, 2, 3, 4))
    assert quality_rules.quality(docs_frame(spark, rows).limit(0)).count() == 0


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
