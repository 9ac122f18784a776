"""Mixing, url filter and decontamination against their SQL and brute force."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from custlens.llm import decontamination, mixing, url_filter
from custlens.llm.queries import ORACLE_SQL
from tests.llm.helpers import ODD, docs_frame, duck_matches, duck_sf_matches, sf_table


def _sources(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w%d" % rng.randrange(50) for _ in range(rng.randint(0, 40))), "en",
             rng.choice(["hot"] * 6 + ["a", "b", "é", "Z", None])) for i in range(600)]
    rows += rows[:5]
    return docs_frame(spark, rows + [(None, "no id here", "en", "b"), (900, None, "en", "a"), (901, "", None, "only")])


def _mixed(docs):
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def test_mix_equals_sql(spark):
    docs = _sources(spark)
    duck_matches(_mixed(docs), ORACLE_SQL["op3_mixing"], documents=docs.toArrow())
    duck_sf_matches(_mixed(sf_table(spark, "documents")), ORACLE_SQL["op3_mixing"], "documents")


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = _sources(spark)
    out = mixing.mix(docs).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    by = {}
    for r in out:
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in out)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1e-3
    # The stated rule, done by hand: share by weight, stop at the cap, share the excess again.
    names = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    size = {s: v[0]["source_size"] for s, v in by.items()}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * total, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        for s in over or list(open_):
            target[s] = 2 * size[s] if over else level * weight[s]
            left -= target[s]
            open_.discard(s)
    for s, v in by.items():
        assert abs(v[0]["target"] - target[s]) < 1e-3
        assert sum(r["taken"] for r in v) == int(v[0]["target"] + 1e-9)
        epochs = int(v[0]["target"]) // size[s] if size[s] else 0
        assert all(r["taken"] >= epochs * r["size"] for r in v)


def test_mix_odd_rows_and_documents(spark):
    docs = docs_frame(spark, ODD).withColumnsRenamed({"n_chars": "taken"})
    assert mixing.mix(docs).count() == len(ODD)
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(_sources(spark))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken"]
    assert out.where("taken <= 0").count() == 0


def test_words_are_counted_as_stated(spark):
    texts = ["", " ", None, "a", " a b ", "a\u00a0b\tc\x0bd", "\n\nx\r\ny", "é è"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
           .select(mixing.n_words(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def _urls():
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        host = rng.choice(["a.example.com", "EXAMPLE.net", "x.net", "q.org", "net", "example.com", "", "badexample.com"])
        path = "/".join(rng.choice(["", "en", "de", "fr", "blog", "p%d" % rng.randint(0, 9),
                                    "".join(rng.choice("abcdefgh") for _ in range(5))]) for _ in range(rng.randint(0, 8)))
        rows.append((i, rng.choice([f"http://{host}/{path}", f"https://{host}/{path}?x=/y://z", f"http://{host}",
                                    f"{host}/{path}", None, "", f"http://{host}#a", f"ftp://{host}//{path}//"])))
    return rows + rows[:3]


def test_url_verdicts_equal_sql(spark):
    pages = spark.createDataFrame(_urls(), "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter.judge(pages)
    duck_matches(out, ORACLE_SQL["op4_url_filter"], pages=pages.toArrow())
    assert {r["verdict"] for r in out.select("verdict").distinct().collect()} == {"allow", "block"}
    duck_sf_matches(url_filter.judge(sf_table(spark, "pages")), ORACLE_SQL["op4_url_filter"], "pages")
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_rules(spark):
    cases = {
        "http://example.net/en/1": ("example.net", "/en/1", "example.net/en/", "allow"),
        "http://www.EXAMPLE.net/en/": ("www.example.net", "/en/", "example.net/en/", "allow"),
        "http://example.net/de/1?q=/en/": ("example.net", "/de/1", "net/", "block"),
        "http://myexample.net/en/1": ("myexample.net", "/en/1", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "https://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
        "x.org/fr/": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    got = [tuple(r) for r in url_filter.judge(pages).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == list(cases.values())


def test_unlabelled_url_of_a_blocked_template(spark):
    """Variable segments become one wildcard, whose labelled urls decide for the rest."""
    rules = (("block", "h.org/x/a"), ("allow", "h.org/y/"))
    rows = [(i, f"http://h.org/x/a{'bcdefghijklmnopqrstuvwxyz'[i % 25]}{'bcdefghijk'[i // 25]}") for i in range(60)]
    rows += [(100, "http://h.org/x/zz"), (101, "http://h.org/w/zz")]
    out = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert out[100]["template"] == "/x/*" and out[100]["rule"] is None and out[100]["verdict"] == "block"
    # Nothing is known of /w, but nearly all urls of its host are blocked.
    assert out[101]["verdict"] == "block"


def test_urls_without_labels_are_judged_by_their_ancestors(spark):
    rules = (("block", "a.org/x/"), ("block", "b.org/x/"), ("allow", "c.org/"))
    rows = [f"http://s{i % 3}.a.org/x/{i}" for i in range(60)] + ["http://s0.a.org/y/1", "http://new.a.org/z"]
    # One folder of three is blocked: the others stay.
    rows += [f"http://b.org/{d}/{i}" for d in "xyz" for i in range(20)] + ["http://c.org/x/1", "http://d.c.org/x/2", "http://q.org/x/3"]
    out = {r["host"] + r["path"]: r["verdict"] for r in url_filter.judge(
        spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).where("rule IS NULL").collect()}
    assert {k for k, v in out.items() if v == "block"} == {"s0.a.org/y/1", "new.a.org/z"}
    assert len(out) == 43


def test_templates_deeper_than_the_tree_are_told_apart(spark):
    rules = (("block", "h.org/a/b/c/d/e/f/bad/x"), ("allow", "h.org/a/b/c/d/e/f/good/x"))
    deep = "http://h.org/a/b/c/d/e/f"
    rows = [f"{deep}/{kind}/x{i}" for kind in ("bad", "good") for i in range(30)]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    out = url_filter.judge(pages, rules).select("template").distinct().collect()
    assert {r["template"] for r in out} == {"/a/b/c/d/e/f/bad/x#", "/a/b/c/d/e/f/good/x#"}


def test_native_plan(spark):
    from tests.helpers import plan_text

    plan = plan_text(url_filter.judge(sf_table(spark, "pages")))
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def _words(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items):
    windows = {}
    for i, t in items:
        w = _words(t)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s: s + n]), set()).add(i)
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w, hit, found = _words(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s: s + n]) in windows:
                    found |= windows[tuple(w[s: s + n])]
                    hit.update(range(s, s + n))
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((d, len(w), len(hit), len(found - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def _contaminated(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(12)] + ["É", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 25])))) for i in range(30)]
    items += [(40, items[-1][1]), (41, None), (42, "..."), (43, "The QUICK brown-fox: jumps over a lazy dog once more again today")]
    docs = []
    for i in range(120):
        w = [rng.choice(vocabulary) if rng.random() < 0.8 else "q%d" % rng.randrange(999) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            src = _words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(src) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = src[a: a + rng.randint(5, 20)]
        docs.append((i, rng.choice([" ", "--"]).join(w)))
    docs += ODD[:8] + [(200, "so THE quick Brown fox jumps over a lazy dog once more"), (201, "of the quick brown fox jumps over a lazy")]
    return docs, items


COLS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_contamination_equals_brute_force_and_sql(spark):
    docs, items = _contaminated(spark)
    d, b = docs_frame(spark, docs).withColumn("row", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination([(r["doc_id"], r["text"]) for r in d.collect()], items)
    out = decontamination.contamination(d, b).select(*COLS)
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    duck_matches(out, ORACLE_SQL["op10_decontamination"], documents=d.toArrow(), benchmark=b.toArrow())
    duck_sf_matches(decontamination.contamination(sf_table(spark, "documents"), sf_table(spark, "benchmark")).select(*COLS),
                    ORACLE_SQL["op10_decontamination"], "documents", "benchmark")
    left = decontamination.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(w[0]) for w in want if not w[5])


def test_benchmark_in_blocks(spark, monkeypatch):
    docs, items = _contaminated(spark)
    d, b = docs_frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination([(r["doc_id"], r["text"]) for r in d.collect()], items)
    assert sum(1 for _ in decontamination.benchmark_blocks(b, 100)) > 3
    whole = decontamination.scan
    monkeypatch.setattr(decontamination, "scan", lambda x, y: whole(x, y, 100))
    got = decontamination.contamination(d, b).select(*COLS)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert decontamination.drop_contaminated(d, b, 100).count() == sum(not w[5] for w in want)


def test_longest_match_and_its_place(spark):
    item = " ".join("i%d" % k for k in range(40))
    text = "a b c " + " ".join("i%d" % k for k in range(7, 31)) + " z " + " ".join("i%d" % k for k in range(12))
    r = decontamination.contamination(docs_frame(spark, [(1, text), (2, "a b")]),
                                      spark.createDataFrame([(9, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert (r[0]["longest_match"], r[0]["longest_at"], r[0]["longest_item"], r[0]["longest_item_at"]) == (24, 3, 9, 7)
    assert r[0]["n_hit"] == 36 and r[1]["longest_match"] == 0 and r[1]["longest_at"] is None


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_frame(spark, ODD)
    out = decontamination.contamination(docs, none).collect()
    assert len(out) == len(ODD) and not any(r["contaminated"] for r in out)
    assert decontamination.contamination(docs.limit(0), none).count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == len(ODD)
