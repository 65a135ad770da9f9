"""Queries of this package, and the SQL that they must agree with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clipgrid.llm import (
    byte_bpe,
    curves,
    inner_products,
    lang_id,
    line_blocks,
    mixing,
    resampling,
    simhash,
    spelling,
    suffix_dedup,
    turn_repair,
    warc,
    weak_rules,
)
from clipgrid.llm.common import table


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, folder, "documents"))


def op2_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, folder, "pages"))


def op4_weak_rules(spark: SparkSession, folder: str) -> DataFrame:
    return weak_rules.verdicts(table(spark, folder, "documents"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op6_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return curves.nearest_neighbours(table(spark, folder, "embeddings"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return line_blocks.extract(table(spark, folder, "pages"), ["page_id", "url"])


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_report(table(spark, folder, "documents"))


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    return lang_id.identify(table(spark, folder, "documents"))


def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair(table(spark, folder, "conversations"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_inner_products(spark: SparkSession, folder: str) -> DataFrame:
    return inner_products.top_products(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_importance_resampling,
        op3_warc,
        op4_weak_rules,
        op5_simhash,
        op6_hilbert_neighbours,
        op7_mixing,
        op8_line_blocks,
        op9_byte_bpe,
        op10_language,
        op11_turn_repair,
        op12_spelling,
        op13_inner_products,
    )
}
SQL: dict[str, str] = {"op4_weak_rules": weak_rules.verdicts_sql(), "op7_mixing": mixing.MIX_SQL, "op13_inner_products": inner_products.SQL}
