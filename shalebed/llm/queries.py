"""Queries over the whole synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, host_rules, language, licenses, near_dup, packing, pii, repeats, sharding, token_files
from .staging import fresh_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(language.labelled()))
    out = language.predict(docs.withColumn("held_out", language.held_out()), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(documents(spark, sf_dir)).drop("kept")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    token_files.write(documents(spark, sf_dir), path)
    return token_files.checksums(spark, path)


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ALL = [op1_language_id, op2_repeated_passages, op3_near_dup, op4_pii, op5_packing, op6_decontamination, op7_license_templates, op8_token_files, op9_host_rules, op10_histogram_sort]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    """None of these results can be told in SQL at a bearable cost; the tests compare each with brute force."""
    return {}
