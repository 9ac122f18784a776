from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.llm import html_extraction as hx
from custlens.llm import personal_data as pii
from tests.llm.helpers import ODD, docs_frame, sf_table

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(s):
    return re.sub(r"[^0-9]", "", s)


def brute_spans(t):
    """The stated patterns, applied directly."""
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= len(_digits(m.group())) <= 19 and luhn(_digits(m.group()))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for alphabet in ("a1.@-+ (2390%", "0123456789 -", "12.5 ", "+1 ()-.23x", "a@.-b"):
        for _ in range(3000):
            t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 45)))
            assert pii.base_spans(t) == brute_spans(t), t


def test_base_spans_are_linear_on_hostile_text():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "1." * 100_000, "+1 " * 70_000, "a.b@c" * 40_000):
        pii.base_spans(t)


@pytest.fixture(scope="module")
def tagged(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(2, 8)))

    def luhn_card():
        d = [rng.randrange(10) for _ in range(15)]
        total = sum(sum(divmod(c * (2 - i % 2), 10)) for i, c in enumerate(d))
        return "".join(map(str, d)) + str(-total % 10)

    def one():
        return rng.choice([
            lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", lambda: luhn_card(),
            lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)),
            lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"])()

    rows = []
    for i in range(500):
        w = [word() for _ in range(rng.randint(10, 80))]
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w)), one())
        rows.append((i, " ".join(w)))
    docs = docs_frame(spark, rows)
    return docs, rows, pii.fit(docs, 200)


def test_tagger_finds_spans_on_its_own(spark, tagged):
    docs, rows, tagger = tagged
    texts = [t for _, t in rows]
    found = pii.tag(tagger, texts)
    want = [set(pii.base_spans(t)) for t in texts]
    hit = sum(len(w & set(f)) for w, f in zip(want, found))
    assert hit >= 0.8 * sum(map(len, want))
    # A span far into a long text is found at its place, whatever the windows.
    a, b, kind = next(s for w in want for s in w if s[2] == "ip")
    text = next(t for t, w in zip(texts, want) if (a, b, kind) in w)
    far = "long text before it " * 500
    assert {(x - len(far), y - len(far), k) for x, y, k in pii.tag(tagger, [far + text])[0]} >= {(a, b, kind)}


def test_gradients():
    rng = np.random.default_rng(0)
    t = pii.Tagger()
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64)
    ids = rng.integers(0, pii.CHARS, (9, 3))
    y = np.zeros((9, 3), np.int64)
    y[2:5, 0] = [1, 2, 2]
    y[4:6, 1] = [3, 4]
    _, g = t.loss_and_grads(ids, y)
    for k, at in (("out", (3, 2)), ("whf", (2, 7)), ("wxb", (1, 30)), ("trans", (0, 1)), ("start", (0,)), ("emb", (ids[2, 0], 4))):
        eps = 1e-3
        t.p[k][at] += eps
        up, _ = t.loss_and_grads(ids, y)
        t.p[k][at] -= 2 * eps
        down, _ = t.loss_and_grads(ids, y)
        t.p[k][at] += eps
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), k


def test_rows_and_masks(spark, tagged):
    docs, rows, tagger = tagged
    out = {r["doc_id"]: r for r in pii.personal_data(docs, tagger).collect()}
    import hashlib

    for i, t in rows:
        base = brute_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert out[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(out[i]["spans"].split(","))
        assert out[i]["n_ip"] == sum(k == "ip" for _, _, k in base)
    masked = pii.mask(docs, tagger)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    for r in masked.collect():
        assert not brute_spans(r["text"]) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark):
    docs = docs_frame(spark, ODD).withColumn("spans", F.lit("x"))
    out = pii.personal_data(docs).collect()
    assert len(out) == len(ODD) and all(r["spans"] == "" and r["n_added"] == 0 for r in out)
    assert pii.personal_data(docs.limit(0)).count() == 0
    assert sorted(map(str, pii.mask(docs).collect())) == sorted(map(str, docs.collect()))


def test_supplied_pages_give_their_article(spark):
    pages = sf_table(spark, "pages").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    rows = {r["page_id"]: r for r in pages.collect()}
    out = hx.extract(pages).collect()
    assert len(out) == len(rows)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", rows[r["page_id"]]["html"], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == rows[r["page_id"]]["url"]


PARAGRAPHS = "<p>One long sentence, with commas, and words. More of it follows here.</p><p>Short.</p>"


@pytest.mark.parametrize("page,want", [
    (f"<body><div class='menu'><a href=x>Home</a> <a>About us, now.</a></div><div id=content><h1>Title</h1>{PARAGRAPHS}</div>"
     "<div class='cookie-notice'>We use cookies, a lot. Read on.</div></body>",
     "Title One long sentence, with commas, and words. More of it follows here. Short."),
    (f"<body><main><article><h2>A &amp; B</h2>{PARAGRAPHS}<form>Name <input> Mail</form><aside>See also</aside></article></main>"
     "<section class=comments><article class=comment><p>I liked it, really, so much. Great, great text.</p></article></section></body>",
     "A & B One long sentence, with commas, and words. More of it follows here. Short."),
    ("<article><p>a<b>b</b>c\n d<br>e<script>no()</script></p><style>x{}</style><ul><li>f<li>g</ul></article>", "abc d e f g"),
    ("<article>&lt;tag&gt; a < b &eacute;&#233; <!-- gone <p> --> x</article>", "<tag> a < b éé x"),
    ("<p>unclosed <b>tags <i>here", "unclosed tags here"),
    ("plain text only", "plain text only"),
    ("<html><body><nav>menu</nav></body></html>", ""),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes, it is.</p></article>", "yes, it is."),
    ("", ""), (None, ""),
])
def test_pages(page, want):
    assert hx.main_text(page) == want


ARTICLE = f"<article><h1>Title</h1>{PARAGRAPHS}</article>"
ARTICLE_TEXT = "Title One long sentence, with commas, and words. More of it follows here. Short."


@pytest.mark.parametrize("page", [
    *(f"<body><div class='{c}'>{ARTICLE}</div></body>"
      for c in ("layout has-sidebar", "with-comments", "menu-open", "no-header", "promo wide", "comments")),
    f"<body><div id='widget'><h1>Title</h1>{PARAGRAPHS}</div><div class='menu'>Home</div></body>",
    f"<body><article><div class='entry-header'><h1>Title</h1></div>{PARAGRAPHS}</article></body>",
    *(f"<body><{e} id=x>{ARTICLE}</body>" for e in ("svg", "math", "object", "canvas", "template", "select")),
    f"<body>{ARTICLE}<div class='related-posts'><article><p>{'Another story, told at length. ' * 20}</p></article></div></body>",
])
def test_names_and_open_elements_do_not_hide_the_content(page):
    assert hx.main_text(page) == ARTICLE_TEXT


@pytest.mark.parametrize("open_, close", [
    ("<p title='the hidden cost'>", "</p>"), ("<p data-id=share>", "</p>"), ("<div data-role='menu'>", "</div>"),
    ('<section id="related-work">', "</section>"), ("<div class='social-science'>", "</div>"), ("<p hidden-by='x' data-hidden>", "</p>"),
    ("<p aria-hidden=false>", "</p>"), ("<div class='search-results'>", "</div>"),
])
def test_other_attributes_and_names_of_other_things_hide_nothing(open_, close):
    page = f"<body><article><h1>Title</h1>{PARAGRAPHS}{open_}This belongs to it, of course.{close}</article></body>"
    assert hx.main_text(page) == ARTICLE_TEXT + " This belongs to it, of course."


@pytest.mark.parametrize("open_, close", [
    ("<p hidden>", "</p>"), ("<p hidden=''>", "</p>"), ("<p data-x='1' hidden>", "</p>"), ("<div class='wide share-buttons'>", "</div>"),
    ("<div id=site-nav>", "</div>"), ("<div role='navigation'>", "</div>"), ("<div class='newsletter_signup'>", "</div>"),
    ("<div class='ad-slot-2'>", "</div>"), ("<div class='relatedPosts'>", "</div>"), ("<div aria-hidden='true'>", "</div>"),
])
def test_named_boilerplate_goes(open_, close):
    page = f"<body><article><h1>Title</h1>{PARAGRAPHS}{open_}Not part of it, really.{close}</article></body>"
    assert hx.main_text(page) == ARTICLE_TEXT


def test_broken_markup_and_empty_tables(spark):
    rng = random.Random(5)
    bits = ["<p>", "</p>", "<", ">", "<div class='", "\"", "<!--", "-->", "<script>", "</script>", "&amp;", "&", "word ", "<a href=\"x>", "<br/>"]
    for _ in range(500):
        hx.main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))
    hx.main_text("<div>" * 20_000 + "deep")
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in hx.extract(pages).collect()] == ["", "", ""]
    assert hx.extract(pages.limit(0)).count() == 0
