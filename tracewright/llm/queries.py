"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_quality, context_mixing, dac, decontaminate, licenses, ngram_join, noisy_or_toxicity, oracles, packing, rules, substrings
from ._common import folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return attention_quality.score(docs, attention_quality.train(docs, _labels(spark, sf_dir)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(_documents(spark, sf_dir))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(_documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    dac.write(_documents(spark, sf_dir), path)
    return dac.digests(spark, path)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return noisy_or_toxicity.score(docs, noisy_or_toxicity.train(docs, _labels(spark, sf_dir))).select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = licenses.scan(docs, licenses.train(docs))
    return found.select("doc_id", F.concat_ws(",", "families").alias("families"), F.size("found").alias("n_paragraphs"), F.coalesce(F.aggregate("found", F.lit(0.0), lambda m, x: F.greatest(m, x["probability"])), F.lit(0.0)).alias("probability"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_decontamination, op3_quality_rules, op4_ngram_jaccard_join, op5_token_files, op6_substring_dedup, op7_toxicity, op8_license_scan, op9_language_model, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": oracles.DECONTAMINATION, "op3_quality_rules": oracles.QUALITY_RULES, "op4_ngram_jaccard_join": oracles.JACCARD, "op6_substring_dedup": oracles.SUBSTRINGS}
