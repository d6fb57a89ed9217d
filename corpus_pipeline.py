"""A corpus from raw documents to packed training sequences, stage by stage.

Toxic documents go, then those of low quality; one document of each group of near
duplicates stays; personal data and terms that disclose it are replaced; what is left
is packed. Each stage reads the Parquet table that the one before it wrote. The models
of the first two stages are trained on the documents that they get, outside the held-out
folds. SQL cannot express the stages; ``tests/llm/test_pipeline.py`` checks what they keep
against the labels of the held-out folds, and the rows of ``run`` against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from purchase_insights.llm import packing, pii, quality, simhash, toxicity
from purchase_insights.llm.queries import quality_model, table, toxicity_model
from purchase_insights.sources.scratch import remove_scratch, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, shingle_words=3, radius=3)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack),
]

#: Trained models, fingerprints and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of ``sf_dir``.

    Each stage's table lies in the shared folder; it goes when the next one is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        result, path = stage(spark, docs, sf_dir), scratch_path(spark, f"stage-{name}")
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            remove_scratch(spark, before)
        before = path
    return docs
