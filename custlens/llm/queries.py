"""The corpus operators applied to the supplied tables: one query per operator, and
DuckDB SQL for those that SQL can express (the others are tested against brute force,
planted cases or held-out labels in ``tests/llm``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custlens.llm import clustering, fill_in_middle, mixing, url_filter
from custlens.llm.common import table
from custlens.llm.decontamination import WINDOW, contamination
from custlens.llm.html_extraction import extract
from custlens.llm.language_id import identify
from custlens.llm.near_duplicates import near_duplicates
from custlens.llm.personal_data import personal_data
from custlens.llm.quality_classifier import quality_scores
from custlens.llm.quality_rules import quality
from custlens.llm.sharding import shard_documents
from custlens.llm.toxicity import toxicity


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fill_in_middle.store_frames(table(spark, sf_dir, "documents"))
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(stored))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_toxicity, op3_mixing, op4_url_filter, op5_language_id, op6_personal_data,
        op7_html_extraction, op8_near_duplicates, op9_quality_rules, op10_decontamination, op11_clustering, op12_sharding, op13_fill_in_middle,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _mixing_sql() -> str:
    w = ", ".join(f"{x}::DOUBLE" for x in mixing.WEIGHTS)
    return f"""
WITH docs AS (
  SELECT doc_id, source, row_number() OVER () AS row, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
  FROM documents),
keyed AS (
  SELECT doc_id, source, row, size,
    -ln((('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(t))), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / coalesce(0.05::DOUBLE + length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / nullif(length(t), 0)::DOUBLE, 0.05::DOUBLE) AS key
  FROM docs),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place
  FROM keyed GROUP BY source),
weighted AS (
  SELECT source, source_size, [{w}][(place % {len(mixing.WEIGHTS)} + 1)::INT] AS weight,
    source_size * {mixing.MAX_EPOCHS}::DOUBLE AS cap, sum(source_size) OVER () * {mixing.BUDGET_SHARE}::DOUBLE AS budget
  FROM sources),
turns AS (
  SELECT *, row_number() OVER o AS turn,
    (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY cap / weight, source IS NULL, source)),
opened AS (SELECT min(turn) AS first_turn, arg_min(level, turn) AS first_level FROM turns WHERE cap > level * weight),
targets AS (
  SELECT source, source_size,
    round(CASE WHEN turn >= first_turn THEN first_level * weight ELSE cap END, 6) AS target FROM turns, opened),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
ordered AS (
  SELECT k.*, p.source_size, p.target, p.epochs, floor(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + least(size, greatest(rest - before, 0)))::BIGINT AS taken
FROM ordered"""


def _decontamination_sql() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS key FROM (
    SELECT item_id, w, least(len(w), {WINDOW}) AS size, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS s
    FROM items WHERE len(w) > 0)),
places AS (
  SELECT row, size, s, array_to_string(w[s:s + size - 1], ' ') AS key FROM (
    SELECT row, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM docs, (SELECT DISTINCT size FROM windows))),
found AS (SELECT row, s, p.size, item_id FROM places p JOIN windows v ON p.key = v.key AND p.size = v.size),
hits AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(generate_series(s, s + size - 1)) AS place FROM found) GROUP BY row),
named AS (
  SELECT row, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found) GROUP BY row)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h USING (row) LEFT JOIN named m USING (row)"""


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": _mixing_sql(),
    "op4_url_filter": url_filter.oracle_sql(),
    "op10_decontamination": _decontamination_sql(),
    "op11_clustering": clustering.oracle_sql(),
    "op13_fill_in_middle": fill_in_middle.oracle_sql(),
}
