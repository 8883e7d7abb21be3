"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, substring_dedup, token_output, url_filters
from .oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "rule string, verdict string")
    # a page's number is its document's
    bad = F.when(F.col("quality").isin(0, 1), 1 - F.col("quality"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    return url_filters.judge(_table(spark, sf_dir, "pages"), rules, labels=labels, suffixes=url_filters.SUFFIXES).drop("bound")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.template_table(spark), apart=True)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    may_learn = _table(spark, sf_dir, "labels").where(~language_id.held_out()).select("doc_id", "quality")
    got = quality_classifier.score(documents, quality_classifier.train(may_learn, documents))
    return got.select("doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_output, op2_minhash_dedup, op3_mixing, op4_quality_rules, op5_language_id, op6_substring_dedup, op7_url_filters, op8_license_scan, op9_decontamination, op10_quality_classifier)
}

__all__ = ["ORACLE_SQL", "QUERIES"]
