"""Registered queries of the corpus operators: each applies one operator with its
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.token_counts import token_counts
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.warc import round_trip
    return round_trip(_table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.simhash import near_duplicates
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.quality_cascade import quality_rows
    return quality_rows(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.toxicity import score_documents
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.suffix_dedup import dedup_digests
    return dedup_digests(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.decontaminate import leaked_pairs
    return leaked_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).selectExpr(
        "*", "true AS contaminated")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.mixing import mix_documents
    return mix_documents(_table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.html_text import extract
    return extract(_table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.langid import identify
    return identify(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.conversation_repair import damaged_audits
    return damaged_audits(_table(spark, sf_dir, "conversations"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.pii import digests
    return digests(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.spelling import spelling_variants
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_simhash": op3_simhash,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_mix_sources": op8_mix_sources,
    "op9_html_main_text": op9_html_main_text,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_pii": op12_pii,
    "op13_spelling_variants": op13_spelling_variants,
}
