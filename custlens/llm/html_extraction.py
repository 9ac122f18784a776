"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its tag path from the root to the node.
Per path, text length and punctuation are summed and divided by the number of nodes.
Both ratios are smoothed along the page with a short Gaussian window, fused (log text
ratio times one plus the punctuation ratio) and averaged per path again.  The path with
the largest fused mass names the content; its nearest sectioning ancestor (article,
main, section, div, td, or the body) is the content root.  Under the root all paths
count but those of marked boilerplate; elsewhere a path counts when it lies under the
same kind of root and its fused ratio reaches a share of the best.

Boilerplate is never content: scripts, styles, heads, forms, navigation, asides,
footers, page headers, hidden parts, and elements whose class, id or role names a menu,
banner, notice, advert, comment section or the like.  A whole class, id or role has to
name it (``menu``, ``site-nav``), not another thing (``related-work``, ``social-science``)
or a state of the page (``has-sidebar``, ``menu-open``); other attributes name nothing.  Names do not mark what holds an article or main or most of the page's
fused text, nor headers inside an article or main.

White space inside a block becomes one space; blocks (cut at block-level tags and line
breaks) are trimmed and joined in page order by one space; character references are
decoded.  A null or empty page has the empty text; broken markup is read leniently
(unknown end tags are ignored, a paragraph ends where a block begins).
"""

from __future__ import annotations

import html as _html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from custlens.llm import textkernel as tk

THRESHOLD = 0.3
SIGMA = 1.0

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas select title".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
SECTION = frozenset("article main section div td body".split())
BOILER_TAGS = frozenset("head nav footer aside form button dialog menu".split())
# Words of class, id and role attributes that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies dialog disqus footer form gdpr header hidden login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "promotion related recommended reply replies respond search share sharing sidebar sidenav signup skip social "
    "sponsor sponsored subscribe subscription toolbar widget".split())
# Words that may stand beside them in a name that marks (site-nav, share-buttons); any other
# word makes it a name of something else (related-work, social-science).
NEUTRAL_WORDS = frozenset(
    "all area bar block body bottom box bs btn button buttons col column container content desktop div el floating fixed "
    "global group holder icon icons inner item items js left link links list lists main message mobile outer overlay page "
    "pages panel post posts primary right row secondary section site slot sticky tab text title toggle top ui unit widget "
    "widgets wrap wrapper zone".split())
# First and last words of names that tell a state of the page (has-sidebar, menu-open).
STATE_FIRST = frozenset("has have with without no not is hide hides show shows".split())
STATE_LAST = frozenset("open opened closed active inactive enabled disabled visible collapsed expanded on off".split())
# An article's own header is content.
OWN_HEADS = frozenset(["header", "masthead"])
# Raw elements that swallow the rest of a page if they are not closed.
SWALLOWS = frozenset("script style title textarea".split())
# A start tag on the left ends an open element on the right.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
ENDS_PARAGRAPH = BLOCK - frozenset(["br", "html", "body", "head", "title", "option"])
STOPS = frozenset("ul ol dl table div section article main body td th aside nav header footer form blockquote".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
# One attribute: its whole name, and its value if it has one.
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_PUNCT = re.compile(r"[.,;:!?…。，、！？；：]")


def _marked(name: str, attrs: str, inside_content: bool) -> int:
    """2: an element is boilerplate by its element name or hidden; 1: a name given to it says so; else 0."""
    if name in BOILER_TAGS or (name == "header" and not inside_content):
        return 2
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0
    named = 0
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key == "hidden" and value.lower() in ("", "hidden") or key == "aria-hidden" and value.lower() == "true":
            return 2
        if key == "style":
            if "display:none" in value.replace(" ", "").lower():
                return 2
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if not words or words[0] in STATE_FIRST or words[-1] in STATE_LAST:
                    continue
                marking = [w for w in words if w in BOILER_WORDS and not (inside_content and w in OWN_HEADS)]
                others = [w for w in words if w not in BOILER_WORDS and not w.isdigit()]
                if marking and NEUTRAL_WORDS.issuperset(others):
                    named = 1
    return named


def text_nodes(page: str) -> list[tuple[int, str, tuple[str, ...], bool]]:
    """(block number, text, tag path, boilerplate) of every text node, in page order."""
    nodes = []
    # Element name, whether it or an ancestor is boilerplate for certain, its nearest named element.
    stack: list[tuple[str, bool, int]] = []
    above_named: list[int] = []   # of each named element the next one above, or -1
    articles: list[int] = []      # the nearest named element around each article and main
    endless: set[str] = set()     # raw elements without an end tag from here on
    path: tuple[str, ...] = ()
    block, at, n = 0, 0, len(page)

    def add(a, b):
        if a < b:
            nodes.append((block, page[a:b], path, *(stack[-1][1:] if stack else (False, -1))))

    start = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            add(start, n)
            return _resolved(nodes, above_named, articles)
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            add(start, at)
            at = start = n if end < 0 else end + 3
            continue
        if page[at + 1: at + 2] in ("!", "?"):
            end = page.find(">", at)
            add(start, at)
            at = start = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, at)
        if m is None:
            if not (page[at + 1: at + 2].isalpha() or page[at + 1: at + 2] == "/"):
                at += 1  # a bare sign is text
                continue
            end = page.find(">", at)
            add(start, at)
            at = start = n if end < 0 else end + 1
            continue
        add(start, at)
        at = start = m.end()
        closing, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if name in BLOCK:
            block += 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    path = tuple(e[0] for e in stack)
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                end = None if name in endless else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if end is not None:
                    at = start = end.end()
                elif name in SWALLOWS:
                    at = start = n
                else:
                    endless.add(name)
            continue
        ends = ENDS.get(name, frozenset())
        if name in ENDS_PARAGRAPH:
            ends = ends | {"p"}
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] in STOPS:
                break
        if attrs.rstrip().endswith("/") and name not in BLOCK:
            continue
        content = any(e[0] in ("article", "main") for e in stack)
        _, certain, named = stack[-1] if stack else ("", False, -1)
        mark = _marked(name, attrs, content)
        if mark == 1:
            above_named.append(named)
            named = len(above_named) - 1
        elif name in ("article", "main") and not mark and not certain:
            articles.append(named)
        stack.append((name, certain or mark == 2, named))
        path = tuple(e[0] for e in stack)


def _resolved(nodes, above_named: list[int], articles: list[int]) -> list[tuple[int, str, tuple[str, ...], bool]]:
    """The nodes with their boilerplate flag.  A name counts, unless the page has no article or
    main free of named elements and this one holds one, or, if the page has none at all, most
    of the fused mass of the text."""
    count = len(above_named)
    drop = [True] * count
    if count and -1 not in articles:
        held = [0.0] * count
        if articles:
            for k in articles:
                held[k] = 1.0
            least = 0.0
        else:
            solid = [(" ".join(t.split()), p, k) for _, t, p, certain, k in nodes if not certain and not t.isspace()]
            score = path_scores([(t, p) for t, p, _ in solid])
            for t, p, k in solid:
                if k >= 0:
                    held[k] += len(t) * score[p]
            least = 0.5 * sum(len(t) * score[p] for t, p, _ in solid)
        for k in range(count - 1, -1, -1):
            if above_named[k] >= 0:
                held[above_named[k]] += held[k]
        drop = [h <= least for h in held]
        for k, up in enumerate(above_named):
            drop[k] = drop[k] or up >= 0 and drop[up]
    return [(b, t, p, certain or k >= 0 and drop[k]) for b, t, p, certain, k in nodes]


def _root(path: tuple[str, ...]) -> tuple[str, ...]:
    """The content root of a path: article or main if there is one, else the nearest section."""
    for names in (("article", "main"), SECTION):
        for k in range(len(path) - 1, -1, -1):
            if path[k] in names:
                return path[: k + 1]
    return path[:1]


def path_scores(nodes) -> dict[tuple[str, ...], float]:
    """Fused, smoothed ratio per tag path of the nodes (text, path)."""
    length, punct, count = {}, {}, {}
    for text, path in nodes:
        length[path] = length.get(path, 0) + len(text)
        punct[path] = punct.get(path, 0) + len(_PUNCT.findall(text))
        count[path] = count.get(path, 0) + 1
    text_ratio = [length[p] / count[p] for _, p in nodes]
    punct_ratio = [punct[p] / count[p] for _, p in nodes]
    kernel = [math.exp(-0.5 * (d / SIGMA) ** 2) for d in (-1, 0, 1)]
    total, seen = {}, {}
    for i, (_, path) in enumerate(nodes):
        weight = t = q = 0.0
        for d, k in zip((-1, 0, 1), kernel):
            if 0 <= i + d < len(nodes):
                weight += k
                t += k * text_ratio[i + d]
                q += k * punct_ratio[i + d]
        fused = math.log1p(t / weight) * (1.0 + q / weight)
        total[path] = total.get(path, 0.0) + fused
        seen[path] = seen.get(path, 0) + 1
    return {p: total[p] / seen[p] for p in total}


def main_text(page: str | None) -> str:
    """The main text of a page, or the empty string."""
    if not page:
        return ""
    kept = [(b, t, p) for b, t, p, boiler in text_nodes(page) if not boiler]
    nodes = []
    for b, t, p in kept:
        if "&" in t:
            t = _html.unescape(t)
        nodes.append((b, t, p))
    solid = [(" ".join(t.split()), p) for _, t, p in nodes if not t.isspace()]
    if not solid:
        return ""
    score = path_scores(solid)
    mass: dict[tuple[str, ...], float] = {}
    for t, p in solid:
        mass[p] = mass.get(p, 0.0) + len(t) * score[p]
    best = max(mass, key=lambda p: (mass[p], p))
    root = _root(best)
    limit = THRESHOLD * score[best]
    wide = root[-1:] == ("body",) or root[-1:] == ("html",)

    def chosen(p):
        if p[: len(root)] == root:
            # Under a bare body a path must look like text; under a section all of it counts.
            return not wide or score.get(p, 0.0) >= limit or p[-1] in ("h1", "h2", "h3", "li", "a", "b", "i", "em", "strong")
        return root[-1] not in ("article", "main") and not wide and score.get(p, 0.0) >= limit and "p" in p

    pick = {p: chosen(p) for p in {p for _, _, p in nodes}}
    out, last = [], None
    for b, t, p in nodes:
        if pick[p]:
            if last is not None and b != last:
                out.append(" ")
            out.append(t)
            last = b
    return " ".join("".join(out).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        tk.map_slices(run, "html"), f"page_id {kind}, url string, text string, n_chars long")
