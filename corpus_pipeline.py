"""A training-data pipeline: toxicity, near-duplicates, contamination, personal data, mix.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All
stages but the last return the columns of ``documents``; the last adds ``taken``, the
words the mix takes from a document (repeats counted).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from custlens.config import ensure_checkpoint_dir
from custlens.llm.common import table
from custlens.llm.decontamination import drop_contaminated
from custlens.llm.mixing import mixed_documents
from custlens.llm.near_duplicates import drop_near_duplicates
from custlens.llm.personal_data import mask
from custlens.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; all documents stay."""
    return mask(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the words taken."""
    return mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
]

# A trained classifier and hashed signatures have no SQL form; tests hold the pipeline
# against its operators and planted rows instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are stored in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
