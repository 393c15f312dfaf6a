"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, group_join, html_tree, licenses, line_dedup, lm_score, mixing, quality, sharding, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.by_document(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(table(spark, sf_dir, "documents"), line_dedup.MOST_EDITS)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.copies(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source")


def op6_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.joined(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table(spark, sf_dir, "documents"), memory=1)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shards(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_main_text, op2_suffix_dedup, op3_licenses, op4_line_dedup, op5_mix_sources, op6_jaccard_groups, op7_decontaminate, op8_pseudo_likelihood, op9_quality_rules, op10_shards)
    return {f.__name__: f for f in every}
