"""The registered queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, decontam, fingerprint, line_dedup, mixing, pii, quality, ranked_search, simhash, spelling, token_count,
               token_output, warc)

COUNT_VOCABULARY, OUTPUT_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"), min_bytes=0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_report(_table(spark, sf_dir, "documents"), vocabulary_path(COUNT_VOCABULARY), limit=512)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_report(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(_table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(_table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), vocabulary_path(OUTPUT_VOCABULARY), end_id=1)


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec_report(_table(spark, sf_dir, "documents"), vocabulary_path(COUNT_VOCABULARY))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(_table(spark, sf_dir, "documents"), min_chars=5, min_count=3, ratio=2, noise=97)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_pii, op3_decontamination, op4_warc, op5_token_counts,
                                    op6_mixing, op7_line_dedup, op8_simhash, op9_token_output, op10_order_minhash,
                                    op11_ranked_search, op12_bpe_codec, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE_SQL, "op6_mixing": mixing.oracle_sql(), "op7_line_dedup": line_dedup.ORACLE_SQL,
            "op11_ranked_search": ranked_search.ORACLE_SQL, "op13_spelling_variants": spelling.oracle_sql()}
