"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A table is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared checkpoint folder (``spark.checkpoint.dir``)."""
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return f"{ensure_checkpoint_dir(spark, allow_local_default=local).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a written table: it outlives a lost executor and is read pruned."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``broadcast`` a written table when its row count proves it small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64) + 16) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
        del batch          # before the next one is read


_TABLE: dict = {}


def worker_table(key, make):
    """The one table that a Python worker keeps between tasks, made by ``make()``.  Workers are used again from
    operator to operator: when another operator asks for its table, the one held till then goes."""
    if key not in _TABLE:
        _TABLE.clear()
        pa.default_memory_pool().release_unused()
        _TABLE[key] = make()
    return _TABLE[key]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (a bijection for each seed), vectorised."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(column) -> F.Column:
    """A column's hash as a number in [0, 1): picks the same sample in every run."""
    return (F.xxhash64(column) / F.lit(2.0**64)) + F.lit(0.5)


# --------------------------------------------------------------------------------------
# Connected components
# --------------------------------------------------------------------------------------

def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the edges of one task: star edges that connect the same nodes."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 500_000:          # bounded memory: hand on what is known so far
            yield from _stars(parent, root, schema)
            parent.clear()
    if schema is not None:
        yield from _stars(parent, root, schema)


def _stars(parent: dict, root, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], schema.field(0).type),
                                          pa.array([p[1] for p in part], schema.field(1).type)], schema=schema)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, root)`` per node that has an edge,
    ``root`` the smallest node of its component.

    Large-star and small-star rounds; every round is one aggregate per node with partial aggregation and a
    join back that Spark can split by skew, and ends in a written table.  The rounds grow with the logarithm
    of the component size.  No edges give an empty table; self-loops and repeated edges are harmless."""
    kind = edges.schema[0].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    now = written(edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))
                  .where("a is not null and b is not null and a != b").mapInArrow(_forest, schema).distinct(), label)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(small, "a")
        now = written(star.select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct(), label)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
