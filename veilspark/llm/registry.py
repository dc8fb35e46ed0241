"""Queries of this package, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.work import table


def op1_balanced_postings_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veilspark.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op4_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.recompress import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_candidate_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.pii import find_private

    return find_private(table(spark, sf_dir, "documents"))


def op9_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.html import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veilspark.llm.licenses import scan_documents

    return scan_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from veilspark.llm import licenses, oracles

    return {"op6_minhash_near_dedup": oracles.NEAR_DUPLICATES, "op8_substring_dedup": oracles.SUBSTRINGS, "op10_license_scan": licenses.oracle()}
