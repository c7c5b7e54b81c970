"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loreseek.llm import media, mixing, packing, pii, quality, secrets, simhash, substrings, topk, warc
from loreseek.llm.common import documents

#: Production parameter of the packing: sources that must not share a sequence.
APART = (("src1", "src2"), ("src3", "src4"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text", "source"), apart=APART)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality.classify(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op3_mix_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir).select("doc_id", "text"))


def op6_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.through_media(documents(spark, sf_dir).select("doc_id", "text"))


def op7_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_classifier,
        op3_mix_to_target_weights,
        op4_simhash_near_dedup,
        op5_secret_scan,
        op6_telephony_audio,
        op7_warc_capture_index,
        op8_suffix_array_dedup,
        op9_exact_top_k,
        op10_personal_data,
    )
}

ORACLES: dict[str, str] = {
    "op3_mix_to_target_weights": mixing.MIX_SQL,
    "op5_secret_scan": secrets.SECRETS_SQL,
    "op7_warc_capture_index": warc.WARC_SQL,
    "op8_suffix_array_dedup": substrings.REPEATS_SQL,
    "op9_exact_top_k": topk.TOPK_SQL,
}
