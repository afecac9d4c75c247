"""The corpus pipeline: the documents table through the training-data operators, stage by stage.

Every stage takes what the stage before it kept, written as Parquet and read again.  All but the last return the
columns of ``documents``; the last encodes the texts that are left.

Of every stage: an empty table gives an empty one; a row whose id is null or repeated is a row like any other, but for
near duplicates, where of equal texts one row stays; further columns, whatever their names, are passed on untouched by all
but the last stage, which returns its own columns only; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.llm import bpe, decontamination, jaccard_join, language, secret_scan
from pagewise.llm.catalog import VOCABULARY
from pagewise.llm.common import read, work_folder
from pagewise.session import ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language can't be told go (null, without letters, or no language likely)."""
    ship_package(spark)
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are alike by 0.8 or more, that with the smallest id stays."""
    ship_package(spark)
    return jaccard_join.keep_one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    ship_package(spark)
    return decontamination.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets are masked in their texts."""
    return secret_scan.redact_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether decoding gives the text back."""
    ship_package(spark)
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    done = bpe.encode_and_decode(docs, path, pattern)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("secrets", secrets), ("byte_bpe", byte_bpe)]

#: Language identification, and so the rest, can't be stated in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; every stage but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
