"""Registered queries of the training-data operators, one an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.llm import cover, jaccard, media, mixing, oracles, packing, pii, quality, secrets, suffix, wavelet
from ancestra.llm.storage import documents, new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find(documents(spark, sf_dir))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "n_guess", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_found", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(documents(spark, sf_dir))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    wavelet.write(documents(spark, sf_dir), folder)
    return wavelet.read(spark, folder)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir), size=3, percent=90)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.fingerprint(media.encode(documents(spark, sf_dir)))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", media.feature().alias("feature"), "fingerprint")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.without_repeats(documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_rules, op2_packing, op3_secret_scans, op4_personal_data, op5_suffix_array_dedup, op6_source_mixing, op7_token_output, op8_jaccard_join, op9_media_columns, op10_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_suffix_array_dedup": oracles.SUBSTRING_BYTES,
        "op6_source_mixing": mixing.ORACLE_SQL,
        "op8_jaccard_join": oracles.JACCARD,
        "op10_substring_dedup": oracles.SUBSTRING_WORDS,
    }
