"""The thin queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralis.llm.common import table
from muralis.llm.oracle import SQL


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.records import token_records

    return token_records(table(spark, sf_dir, "documents"), vocabulary())


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("rk")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.bpe_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.substring import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op11_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.packing import pack_sequences

    return pack_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.runs import digest, periodic_runs, with_planted_periods

    return digest(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from muralis.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), typo=97)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_main_text": op3_main_text,
    "op4_personal_data": op4_personal_data,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_repeated_passages": op9_repeated_passages,
    "op10_source_mix": op10_source_mix,
    "op11_sequence_packing": op11_sequence_packing,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = dict(SQL)
