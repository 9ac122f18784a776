from __future__ import annotations

import random

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.helpers import SF


def test_registered_queries():
    keys = entry.queries()
    assert [sum(k.startswith(f"op{n}_") for k in keys) for n in range(1, 11)] == [1] * 10
    assert keys["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= set(keys)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]


def test_stages_act_on_planted_rows(spark, scratch):
    """Planted toxic, copied, contaminated and private documents meet their stage; clean ones stay."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgimnost") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(300):
        w = [word() for _ in range(rng.randint(30, 90))]
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            w.insert(rng.randrange(len(w)), "zgrumpfel")
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    item = [word() for _ in range(30)]
    docs[1] = (1, docs[1][1] + " " + " ".join(item[3:18]), "en", "s1", 0)
    near = docs[2][1].split()
    near[0] = "changed"
    docs += [(500, " ".join(near), "en", "s2", 0), (501, docs[3][1], "en", "s3", 0),
             (502, " ".join(word() for _ in range(40)) + " mail abc.def@example.com now", "en", "s0", 0)]
    docs = [(*d[:4], len(d[1])) for d in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    frame = spark.read.parquet(f"{scratch}/documents.parquet")
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, scratch).write.parquet(f"{scratch}/out/{k}")
        before, frame = frame, spark.read.parquet(f"{scratch}/out/{k}")
        if name != "mixing":
            assert frame.columns == before.columns
        left.append({r["doc_id"] for r in frame.select("doc_id").collect()})
    clean = {i for i in range(300) if i % 6} - {1}
    assert len(left[0] & {i for i in range(300) if i % 6 == 0}) <= 3
    assert clean | {1, 500, 501, 502} <= left[0]
    assert left[0] - left[1] == {500, 501}
    assert left[1] - left[2] == {1} and clean <= left[2]
    assert left[3] == left[2]
    masked = spark.read.parquet(f"{scratch}/out/3").where("doc_id = 502").first()["text"]
    assert "abc.def" not in masked and "[EMAIL]" in masked
    assert left[4] <= left[3] and frame.where("taken <= 0").count() == 0
    again = corpus_pipeline.run(spark, scratch)
    assert sorted(map(str, again.select("doc_id", "taken").collect())) == sorted(
        map(str, frame.select("doc_id", "taken").collect()))


def test_run_over_supplied_tables(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "taken"]
    assert out.count() > 0
