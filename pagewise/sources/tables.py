"""Readers for the parquet tables the library works on.

Columns are selected by the callers, so Catalyst prunes the parquet scan
(``ReadSchema`` in the plan) and pushes filters into it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """Read one table.  With ``spread``, an input that plans fewer scan tasks than
    the cluster's parallelism (e.g. a single-row-group file) is hash-spread on its first (id) column
    over ``defaultParallelism`` partitions, so per-row work (tokenising, parsing)
    is not confined to one task.  Large inputs already have many splits and are
    left untouched (no extra shuffle)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_input(df) if spread else df


def spread_input(df: DataFrame) -> DataFrame:
    """Hash-spread an input that plans fewer scan tasks than the parallelism."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, df.columns[0])
