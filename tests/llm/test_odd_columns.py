"""Clashing column names, ids that are text, hot ids in samples, rows without a language."""

from __future__ import annotations

from pyspark.sql import functions as F

from custlens.llm.common import sample_by_hash, with_free_names
from custlens.llm.decontamination import contamination, drop_contaminated
from custlens.llm.mixing import mixed_documents
from custlens.llm.near_duplicates import drop_near_duplicates, near_duplicates
from custlens.llm.personal_data import mask, personal_data
from custlens.llm.quality_rules import count_ngrams, quality
from custlens.llm.toxicity import ToxicityModel, fit, score
from tests.llm.helpers import docs_frame, sf_table

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"


def clashing(docs, *names):
    return docs.withColumns({n: F.lit(777) for n in names})


def test_stages_keep_columns_of_any_name(spark):
    docs = docs_frame(spark, [(1, LONG), (2, LONG), (3, "quite another text of a few words"), (None, "without an id")])
    names = ("toxicity", "_row", "gone_id", "gone_row", "shared_id", "mix_taken", "mix_doc_id", "mix_source", "mix_digest", "Row", "node")
    many = clashing(docs, *names)
    near = drop_near_duplicates(many)
    assert near.columns == many.columns and near.count() == 3
    mixed = mixed_documents(many)
    assert mixed.columns == [*many.columns, "taken"]
    clean = drop_contaminated(many, spark.createDataFrame([(1, LONG)], "item_id long, text string"))
    assert clean.columns == many.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "None"]
    hidden = mask(many)
    assert hidden.columns == many.columns
    for df in (near, mixed, clean, hidden):
        assert all(r[n] == 777 for r in df.collect() for n in names)


def test_toxicity_column_of_the_input_is_kept(spark):
    import numpy as np

    from custlens.llm import toxicity

    flat = ToxicityModel(np.zeros(1 << toxicity.BITS), -1.0)
    docs = clashing(docs_frame(spark, [(1, LONG), (2, None)]), "Toxicity")
    out = with_free_names(docs, ("toxicity",), lambda rows: score(rows, flat, tuple(rows.columns)).where("toxicity < 0.5").drop("toxicity"))
    assert out.columns == docs.columns and [r["Toxicity"] for r in out.collect()] == [777, 777]


def test_text_ids(spark):
    docs = docs_frame(spark, [(1, LONG), (2, LONG), (3, "mail me at a@b.org or 10.0.0.1"), (None, None)]).withColumn(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs).collect()}
    assert got == {"d1": "d1", "d2": "d1", "d3": "d3", None: None}
    assert {r["doc_id"]: (r["n_email"], r["n_ip"]) for r in personal_data(docs).collect()}["d3"] == (1, 1)
    items = spark.createDataFrame([("i2", LONG), ("i10", LONG)], "item_id string, text string")
    rows = {r["doc_id"]: r for r in contamination(docs, items).collect()}
    assert rows["d1"]["n_items"] == 2 and rows["d1"]["longest_match"] == 13 and rows["d3"]["n_hit"] == 0
    assert rows["d1"]["longest_item"] in ("i2", "i10")


def test_samples_are_bounded_by_rows(spark):
    docs = docs_frame(spark, [(7, f"text {i}") for i in range(60)] + [(i, "other") for i in range(5)])
    a, b = ([tuple(r) for r in sample_by_hash(d, 3, "doc_id", "text").collect()] for d in (docs, docs.repartition(5)))
    assert len(a) == 3 and a == b
    labels = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(8)], "doc_id long, quality int, toxic int")
    assert fit(docs, labels, max_fit_docs=4) is not None


def test_no_language_is_not_the_empty_language(spark):
    docs = docs_frame(spark, [(1, LONG, None, "s"), (2, LONG, "", "s"), (3, LONG, "en", "s")])
    assert count_ngrams(docs).select("lang").distinct().count() == 3
    assert quality(docs).count() == 3


def test_fits_read_anywhere_in_a_text(spark):
    from custlens.llm.common import hashed_place

    docs = docs_frame(spark, [(i, "x" * 10_000) for i in range(200)] + [(900, ""), (901, "ab")])
    at = [r[0] for r in docs.select(hashed_place(3000)).collect()]
    assert min(at) == 1 and max(at) > 6000 and max(at) <= 7001 and at[-2:] == [1, 1]
    assert sf_table(spark, "documents").select(hashed_place(10)).where("1 = 0").count() == 0
