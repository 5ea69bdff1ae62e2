"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import (
    lexical, licenses, line_runs, near_duplicates, packing, pieces, pii, quality, sharding, spellings, token_files, topk, urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(_documents(spark, sf))


def op2_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.report(_documents(spark, sf))


def op3_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.report(_documents(spark, sf))


def op4_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.report(_documents(spark, sf))


def op5_urls(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf}/pages.parquet"))


def op6_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.report(_documents(spark, sf))


def op7_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.report(_documents(spark, sf))


def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.report(_documents(spark, sf))


def op9_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.report(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op10_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(_documents(spark, sf))


def op11_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.report(_documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op12_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_runs.report(_documents(spark, sf))


def op13_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return spellings.report(_documents(spark, sf))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_packing, op2_token_files, op3_sentencepiece, op4_sharding, op5_urls, op6_pii, op7_near_duplicates,
        op8_licenses, op9_topk, op10_quality, op11_lexical, op12_line_dedup, op13_spellings)
}

ORACLE: dict[str, str] = {
    "op5_urls": urls.ORACLE,
    "op8_licenses": licenses.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_quality": quality.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op12_line_dedup": line_runs.ORACLE,
    "op13_spellings": spellings.ORACLE,
}
