"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is rotated by ``H D1 H D2 H D3`` (random signs, fast Hadamard transform) and falls to the nearest
signed axis: the largest coordinate by magnitude and its sign.  Each of ``TABLES`` independent rotations gives a
table of ``2 * dimension`` buckets.  A query looks into the ``PROBES`` likeliest buckets of each table (those of its
own largest coordinates), and all vectors found there are ranked by their exact distance.

Equal vectors are one entry of the index with its smallest ids, which is all that a list of neighbours can hold.
Queries are taken in blocks of a bounded size; each block is one pass over the index, whose tasks keep their best
candidates for each query.  Queries that meet fewer candidates than asked for are ranked against the whole index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, written

TABLES = 16
PROBES = 8
#: Queries that one pass over the index answers.
QUERY_BLOCK = 2048
#: Ids that the index keeps of equal vectors: more than a query may ask for.
KEEP = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, of a length that is a power of two, scaled to keep norms."""
    n = x.shape[1]
    x = x.copy()
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int, seed: int = 0) -> np.ndarray:
    """Unit vectors, padded to a power of two, after the table's pseudo-random rotation."""
    size = 1 << max(int(np.ceil(np.log2(x.shape[1]))), 0)
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for k in range(3):
        signs = (mix64(np.arange(size), seed * 1_000_003 + table * 3 + k) >> np.uint64(63)).astype(np.float64) * 2 - 1
        x = hadamard(x * signs)
    return x


def nearest_axis(x: np.ndarray) -> np.ndarray:
    """Bucket of each row: the axis of the largest magnitude, its sign in the lowest bit."""
    axis = np.abs(x).argmax(1)
    return 2 * axis + (x[np.arange(len(x)), axis] < 0)


def probes(x: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` likeliest buckets of each row, best first: the axes by signed coordinate."""
    both = np.stack((x, -x), 2).reshape(len(x), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :n]


def buckets(x: np.ndarray, tables: int, seed: int = 0) -> np.ndarray:
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return np.stack([nearest_axis(rotated(x, t, seed)) for t in range(tables)], 1).astype(np.int32)


def usable(column: str = "embedding") -> F.Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    c = F.col(column)
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(good, F.lit(False)) & F.coalesce(F.exists(c, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in batch.column("vector").to_pylist()])
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        yield own, _matrix(batch.column("vector").take(pa.array(own)))


def build_index(vectors: DataFrame, tables: int = TABLES, seed: int = 0, keep: int = KEEP) -> DataFrame:
    """The written index of ``vectors(vec_id, embedding)``: one entry for each distinct usable vector, with its
    ``keep`` smallest ids and its bucket in every table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes: list = [None] * batch.num_rows
            for own, x in _by_length(batch):
                for i, c in zip(own, buckets(x, tables, seed)):
                    codes[i] = c
            yield pa.RecordBatch.from_arrays([batch.column("vector"), batch.column("ids"), pa.array(codes, pa.list_(pa.int32()))],
                                             names=["vector", "ids", "codes"])
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable("vector"))
    # a vector that a third of all rows hold is counted in every task first, and cut to its smallest ids there
    counted = rows.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    unique = counted.where("n = 1").select("vector", F.array("low").alias("ids"))
    repeated = counted.where("n > 1").select(F.col("vector").alias("same"))
    order = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.join(repeated, F.col("vector") == F.col("same"), "left_semi").withColumn(
        "r", F.dense_rank().over(order)).where(F.col("r") <= keep)
    many = ranked.groupBy("vector").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    return written(unique.unionByName(many).mapInArrow(run, "vector array<double>, ids array<bigint>, codes array<int>"), "ann-index")


def _ranked(held, k: int):
    """Best ``k`` of a task for each query of the block: rows (query_id, vec_id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value                       # query ids, vectors, and per table a mask (query, bucket); no masks: all are found
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            codes = np.array(batch.column("codes").to_pylist(), np.int64)
            for own, x in _by_length(batch):
                if x.shape[1] not in block:
                    continue
                q_ids, q, masks = block[x.shape[1]]
                found = np.full((len(q), len(own)), not masks)
                for t, mask in enumerate(masks):
                    found |= mask[:, codes[own, t]]
                for i in range(len(q)):
                    at = np.flatnonzero(found[i])
                    if not len(at):
                        continue
                    d = np.sqrt(((x[at] - q[i]) ** 2).sum(1))
                    if len(at) > k + 1:           # one entry may be the query's own
                        limit = np.partition(d, k)[k]
                        at, d = at[d <= limit], d[d <= limit]
                    n = [len(ids[own[j]]) for j in at]
                    v = np.array([c for j in at for c in ids[own[j]]], np.int64)
                    d = np.repeat(d, n)
                    d, v = d[v != q_ids[i]], v[v != q_ids[i]]
                    if int(q_ids[i]) in best:
                        d, v = np.append(best[int(q_ids[i])][0], d), np.append(best[int(q_ids[i])][1], v)
                    o = np.lexsort((v, d))[:k]
                    best[int(q_ids[i])] = (d[o], v[o])
        rows = [(i, v, d) for i, (ds, vs) in best.items() for d, v in zip(ds, vs)]
        yield pa.RecordBatch.from_arrays([pa.array([int(r[j]) if j < 2 else float(r[j]) for r in rows], t) for j, t in enumerate(
            (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])
    return run


def search(index: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, n_probes: int = PROBES, seed: int = 0,
           keep: int = KEEP) -> DataFrame:
    """The ``k`` nearest found for each of ``queries(vec_id, embedding)`` by Euclidean distance, without the query's
    own id: ``query_id, rank, vec_id, score``; nearest first, ties to the smaller id.  Fewer only if there are no more.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do ids that are null;
    vectors of another length are no candidates.  Rows with the query's id are no candidates either.  Repeated query
    rows are answered once.  An empty table gives no rows.  ``keep`` is that of the index, and more than ``k``."""
    if k >= keep:
        raise ValueError(f"an index that keeps {keep} ids of equal vectors can't give {k} neighbours")
    spark = index.sparkSession
    rows = written(queries.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable("vector")).groupBy("vec_id").agg(F.min("vector").alias("vector")), "ann-queries")

    def answered(rows: DataFrame, probed: bool) -> DataFrame:
        blocks = -(-rows.count() // QUERY_BLOCK) or 1
        best = None
        for b in range(blocks):
            taken = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()     # about QUERY_BLOCK rows
            block = {}
            for d in {len(r.vector) for r in taken}:
                own = [r for r in taken if len(r.vector) == d]
                q = np.array([r.vector for r in own], np.float64)
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                masks = []
                for t in range(tables if probed else 0):
                    x = rotated(unit, t, seed)
                    mask = np.zeros((len(q), 2 * x.shape[1]), bool)
                    np.put_along_axis(mask, probes(x, n_probes), True, 1)
                    masks.append(mask)
                block[d] = (np.array([r.vec_id for r in own], np.int64), q, masks)
            part = index.mapInArrow(_ranked(spark.sparkContext.broadcast(block), k), "query_id long, vec_id long, score double")
            best = part if best is None else best.unionByName(part)
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = written(answered(rows, True), "ann-found")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("full"))
    short = written(rows.join(full, F.col("vec_id") == F.col("full"), "left_anti"), "ann-short")
    if short.isEmpty():
        return found
    return found.join(full, F.col("query_id") == F.col("full"), "left_semi").unionByName(answered(short, False))


def op8(spark, embeddings: DataFrame) -> DataFrame:
    """The contract's queries: ids that 100 divides."""
    queries = embeddings.where(F.col("vec_id") % 100 == 0)
    return search(build_index(embeddings), queries)
