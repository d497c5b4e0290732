"""The corpus pipeline: stages over documents, each written as Parquet and read as the next one's input.

Quality rules and the quality classifier drop the documents they reject, near-duplicates leave one
document of each group, mixing takes documents as often as the target weights ask (not at all, once
or twice), and BPE encodes what is left. Every stage but the last returns the columns of documents.
Stages that send texts to Python hold the session's Arrow batches to a few megabytes: frames are lazy,
so the setting stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from textwarden.llm import bpe, mixing, quality_classifier, quality_rules, similar
from textwarden.llm.common import small_batches, temporary


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality_rules.filter_documents(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.filter_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similar.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids; a document that the mix takes twice has two rows."""
    small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep=("doc_id", "source"))


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("bpe", encode),
]

#: BPE, the fitted rules and graph components have no SQL form; brute force tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, with a Parquet table in the shared folder between two stages."""
    base = temporary(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
