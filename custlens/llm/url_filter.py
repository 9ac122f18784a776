"""URL filters from path-template trees, with DataFrame functions only.

* Rules.  A rule (host, path) fits a url whose host is the rule's or a subdomain of it
  and whose path starts with the rule's; the longest fitting rule decides.  Urls that a
  rule decides are the labelled ones.
* Tree.  Per host, paths are cut into segments with digit runs written as ``#``.  Going
  down from the root through ``DEPTH`` levels, a node with at least ``MIN_CHILDREN``
  different children is variable: its children with less than a tenth of its urls become
  the wildcard ``*``.  A path's template is the list of its generalised segments; what
  lies deeper stays as it is, so templates of any depth are told apart.
* Merging.  A labelled branch whose share of blocked urls does not differ from that of
  its labelled siblings together (two-proportion z below 1.96) is pooled with the
  siblings for which the same holds.
* Purity.  A template is rejected when the blocked share of its labelled urls, smoothed by
  ``PRIOR_WEIGHT`` urls of its parent branch's share, is at least one half.  A branch's
  share is that of blocked urls among all its urls, labelled or not, smoothed in turn by
  its host's, the host's by its parent domain's, the domain's by ``PRIOR_BLOCKED``.  So a
  template without a labelled url is judged by its nearest ancestors: a host whose
  labelled urls are mostly blocked loses its others too, one blocked folder among many
  does not speak for the rest.

Urls are first reduced to counts per (host, shape), by partial aggregation, so the tree
works on distinct shapes and a host with a third of all pages weighs no more than its
shapes do.

Special rows: a null url or one without ``://`` has an empty host and path; an empty
table gives no rows; repeated rows count as often as they come.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import persisted

RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
DEPTH = 5
MIN_CHILDREN = 8
RARE_SHARE = 0.1
MERGE_Z = 1.96
PRIOR_WEIGHT = 4.0
PRIOR_BLOCKED = 0.2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, start = text[: text.index("/")], text[text.index("/"):]
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments of a path with digit runs as ``#``, joined by ``/``."""
    trimmed = F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/+", "/")
    return F.regexp_replace(trimmed, "[0-9]+", "#")


def templates(shapes: DataFrame) -> DataFrame:
    """(host, shape, template) from the counted shapes (host, shape, n, ...)."""
    tree = shapes.select("host", "shape", "n", F.lit("").alias("template"))
    for depth in range(DEPTH):
        segment = F.when(F.col("shape") == "", F.lit(None)).otherwise(F.get(F.split("shape", "/"), F.lit(depth)))
        tree = tree.withColumn("segment", segment)
        children = tree.where("segment IS NOT NULL").groupBy("host", "template", "segment").agg(F.sum("n").alias("own"))
        nodes = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum("own").alias("all"))
        rare = (
            children.join(nodes.where(F.col("children") >= MIN_CHILDREN), ["host", "template"])
            .where(F.col("own") < F.col("all") * RARE_SHARE).select("host", "template", "segment", F.lit("*").alias("wild"))
        )
        step = F.coalesce("wild", "segment")
        tree = tree.join(rare, ["host", "template", "segment"], "left").select(
            "host", "shape", "n",
            F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), step)).alias("template"))
        tree = persisted(tree)
    parts = F.split("shape", "/")
    deeper = F.when(F.size(parts) > DEPTH, F.concat(F.lit("/"), F.array_join(F.slice(parts, DEPTH + 1, F.size(parts)), "/")))
    return tree.select("host", "shape", F.concat("template", F.coalesce(deeper, F.lit(""))).alias("template"))


def judged_templates(shapes: DataFrame, placed: DataFrame) -> DataFrame:
    """(host, template, purity, template_verdict) with similar branches pooled."""
    own = (
        shapes.join(placed, ["host", "shape"]).groupBy("host", "template")
        .agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled"), F.sum("n").alias("n"))
        .withColumns({"parent": F.regexp_replace("template", "/[^/]*$", ""), "domain": F.regexp_replace("host", r"^[^.]*\.", "")})
    )
    own = persisted(own)
    siblings = own.groupBy("host", "parent").agg(
        F.sum("blocked").alias("all_blocked"), F.sum("labelled").alias("all_labelled"), F.sum("n").alias("all_n"))
    hosts = own.groupBy("host").agg(F.sum("blocked").alias("host_blocked"), F.sum("n").alias("host_n"))
    domains = own.groupBy("domain").agg(F.sum("blocked").alias("domain_blocked"), F.sum("n").alias("domain_n"))
    rest = F.col("all_labelled") - F.col("labelled")
    middle = (F.col("all_blocked") + 1.0) / (F.col("all_labelled") + 2.0)
    spread = F.sqrt(middle * (1.0 - middle) * (1.0 / F.col("labelled") + 1.0 / rest))
    apart = F.abs(F.col("blocked") / F.col("labelled") - (F.col("all_blocked") - F.col("blocked")) / rest)
    both = (F.col("labelled") > 0) & (rest > 0)
    tested = own.join(siblings, ["host", "parent"]).withColumn(
        "alike", F.when(both, F.try_divide(apart, spread) < MERGE_Z).otherwise(False))
    pooled = tested.where("alike").groupBy("host", "parent").agg(
        F.sum("blocked").alias("pool_blocked"), F.sum("labelled").alias("pool_labelled"))
    used = tested.join(pooled, ["host", "parent"], "left").join(hosts, "host").join(domains, "domain")
    blocked = F.when(F.col("alike"), F.col("pool_blocked")).otherwise(F.col("blocked"))
    labelled = F.when(F.col("alike"), F.col("pool_labelled")).otherwise(F.col("labelled"))
    share = F.lit(PRIOR_BLOCKED)
    for level in ("domain", "host", "all"):
        share = (F.col(f"{level}_blocked") + PRIOR_WEIGHT * share) / (F.col(f"{level}_n") + PRIOR_WEIGHT)
    purity = (blocked + PRIOR_WEIGHT * share) / (labelled + PRIOR_WEIGHT)
    return used.select("host", "template", purity.alias("purity")).withColumn(
        "template_verdict", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", shape(F.col("path")).alias("shape"), rule.alias("rule"), verdict.alias("given"))
    shapes = persisted(rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("given").alias("labelled"),
        F.count(F.when(F.col("given") == "block", 1)).alias("blocked")))
    placed = templates(shapes)
    found = persisted(placed.join(judged_templates(shapes, placed), ["host", "template"]).select(
        "host", "shape", "template", "template_verdict"))
    return rows.join(found, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("given", "template_verdict").alias("verdict"), "template")


def oracle_sql(rules=RULES) -> str:
    """The same result in DuckDB SQL over the view ``pages``."""
    longest_first = sorted(rules, key=lambda r: -len(r[1]))

    def pick(value):
        cases = []
        for what, text in longest_first:
            name, start = text[: text.index("/")], text[text.index("/"):]
            cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}') "
                         f"THEN '{value(what, text)}'")
        return "CASE " + " ".join(cases) + " END"

    ctes = [
        "cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        f"split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, "
        "regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut)",
        f"ruled AS (SELECT *, {pick(lambda w, t: t)} AS rule, {pick(lambda w, t: w)} AS given, "
        "string_split(regexp_replace(regexp_replace(trim(path, '/'), '/+', '/', 'g'), '[0-9]+', '#', 'g'), '/') AS parts FROM split)",
        "shaped AS (SELECT page_id, host, path, rule, given, array_to_string(parts, '/') AS shape FROM ruled)",
        "shapes AS (SELECT host, shape, count(*) AS n, count(given) AS labelled, count(*) FILTER (given = 'block') AS blocked "
        "FROM shaped GROUP BY ALL)",
        "tree0 AS (SELECT host, shape, n, '' AS template FROM shapes)",
    ]
    for d in range(DEPTH):
        ctes += [
            f"seg{d} AS (SELECT *, CASE WHEN shape = '' THEN NULL ELSE string_split(shape, '/')[{d + 1}] END AS segment FROM tree{d})",
            f"kids{d} AS (SELECT host, template, segment, sum(n) AS own FROM seg{d} WHERE segment IS NOT NULL GROUP BY ALL)",
            f"rare{d} AS (SELECT host, template, segment FROM (SELECT *, count(*) OVER w AS children, sum(own) OVER w AS every "
            f"FROM kids{d} WINDOW w AS (PARTITION BY host, template)) WHERE children >= {MIN_CHILDREN} AND own < every * {RARE_SHARE}::DOUBLE)",
            f"tree{d + 1} AS (SELECT s.host, s.shape, s.n, CASE WHEN s.segment IS NULL THEN s.template ELSE s.template || '/' || "
            f"CASE WHEN r.segment IS NULL THEN s.segment ELSE '*' END END AS template FROM seg{d} s "
            f"LEFT JOIN rare{d} r ON s.host = r.host AND s.template = r.template AND s.segment = r.segment)",
        ]
    w = PRIOR_WEIGHT
    ctes += [
        f"placed AS (SELECT host, shape, template || CASE WHEN len(string_split(shape, '/')) > {DEPTH} "
        f"THEN '/' || array_to_string(string_split(shape, '/')[{DEPTH + 1}:], '/') ELSE '' END AS template FROM tree{DEPTH})",
        "own AS (SELECT t.host, t.template, regexp_replace(t.template, '/[^/]*$', '') AS parent, regexp_replace(t.host, '^[^.]*\\.', '') AS domain, "
        "sum(blocked) AS b, sum(labelled) AS l, sum(n) AS n FROM placed t JOIN shapes s ON t.host = s.host AND t.shape = s.shape GROUP BY ALL)",
        "shares AS (SELECT *, sum(b) OVER w AS ab, sum(l) OVER w AS al, sum(n) OVER w AS an, sum(b) OVER h AS hb, sum(n) OVER h AS hn, "
        "sum(b) OVER d AS db, sum(n) OVER d AS dn FROM own "
        "WINDOW w AS (PARTITION BY host, parent), h AS (PARTITION BY host), d AS (PARTITION BY domain))",
        f"sib AS (SELECT *, (ab + {w}::DOUBLE * ((hb + {w}::DOUBLE * ((db + {w}::DOUBLE * {PRIOR_BLOCKED}::DOUBLE) / (dn + {w}::DOUBLE))) "
        f"/ (hn + {w}::DOUBLE))) / (an + {w}::DOUBLE) AS share FROM shares)",
        "test AS (SELECT *, CASE WHEN l > 0 AND al > l THEN coalesce(abs(b / l - (ab - b) / (al - l)) "
        "/ nullif(sqrt((ab + 1.0::DOUBLE) / (al + 2.0::DOUBLE) * (1.0::DOUBLE - (ab + 1.0::DOUBLE) / (al + 2.0::DOUBLE)) "
        f"* (1.0::DOUBLE / l + 1.0::DOUBLE / (al - l))), 0) < {MERGE_Z}::DOUBLE, false) ELSE false END AS alike FROM sib)",
        "pool AS (SELECT *, sum(CASE WHEN alike THEN b END) OVER w AS pb, sum(CASE WHEN alike THEN l END) OVER w AS pl "
        "FROM test WINDOW w AS (PARTITION BY host, parent))",
        f"verdicts AS (SELECT host, template, CASE WHEN ((CASE WHEN alike THEN pb ELSE b END) + {w}::DOUBLE * share) "
        f"/ ((CASE WHEN alike THEN pl ELSE l END) + {w}::DOUBLE) >= 0.5 THEN 'block' ELSE 'allow' END AS v FROM pool)",
    ]
    return (
        "WITH " + ",\n".join(ctes) + "\nSELECT p.page_id, p.host, p.path, p.rule, coalesce(p.given, v.v) AS verdict, t.template "
        "FROM shaped p JOIN placed t ON p.host = t.host AND p.shape = t.shape "
        "JOIN verdicts v ON v.host = t.host AND v.template = t.template"
    )
