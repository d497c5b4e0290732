"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import ann, bpe, html_text, licenses, mixing, quality_classifier, quality_rules, simhash, token_files, url_filter
from textwarden.llm.common import temporary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return ann.search(ann.index(embeddings), embeddings.filter(F.col("vec_id") % 20 == 0))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(documents, _table(spark, sf_dir, "labels"))
    return quality_classifier.score(documents, model).select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = temporary(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda f: f["license"])))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.size("found").cast("long").alias("n_found"), F.get(F.col("found"), F.lit(0))["start"].alias("first_start"), F.get(F.col("found"), F.lit(0))["end"].alias("first_end"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_bpe": op1_bpe,
        "op2_ann": op2_ann,
        "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_token_files": op6_token_files,
        "op7_simhash": op7_simhash,
        "op8_html_text": op8_html_text,
        "op9_url_filter": op9_url_filter,
        "op10_licenses": op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op9_url_filter": url_filter.oracle(),
    }
