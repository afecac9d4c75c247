"""Registered queries of this subpackage and, where SQL can state the result, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, decontamination, jaccard_join, language, merkle, nearest, passages, phrases, pii, quality,
               secret_scan, token_counts, warc)
from .common import read
from .sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
COUNTED = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op1(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op2(spark, read(spark, sf_dir, "pages"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op3(spark, read(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op4(spark, read(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op5(spark, read(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op6(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY),
                   public_tokenizers.PATTERN)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.op7(spark, read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.op8(spark, read(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op9(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op10(spark, read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op11(spark, read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op12(spark, read(spark, sf_dir, "documents"), public_tokenizers.path(COUNTED))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.op13(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_decontamination, op2_warc, op3_pii, op4_language, op5_secret_scan, op6_byte_bpe, op7_substring_dedup, op8_nearest, op9_quality,
    op10_jaccard_join, op11_merkle_manifest, op12_token_counts, op13_phrase_collocations)}
