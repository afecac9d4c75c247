"""A keyed table for micro-batches: each batch writes the keys that it changes, and reads the keys that it meets.

``delta/batch=N`` holds what batch N put (``alive``) or removed, ``base/upto=M`` the last version of every key up to batch
M, and ``marks/upto=M`` says that this base is complete.  All are dealt into buckets by the key's hash, so that a lookup
opens only the buckets its keys fall in.  A batch that is run again writes the same folder again, and nothing from
a batch's own or a later number is ever read for it; a missing folder is an error, not an empty state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
COMPACT_EVERY = 20


class KeyedTable:
    """Versions of rows of ``schema`` by the column ``key``, in the shared folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = BUCKETS,
                 compact_every: int = COMPACT_EVERY):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema, self.buckets, self.compact_every = schema, buckets, compact_every
        self.stored = T.StructType([*schema.fields, T.StructField("alive", T.BooleanType()),
                                    T.StructField("bucket", T.IntegerType())])
        spark.createDataFrame([], "upto long").write.mode("ignore").parquet(f"{self.path}/marks/start")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _base(self, before: int) -> int:
        """The last batch of the newest complete base that lies before ``before``; -1: there is none."""
        marks = self.spark.read.schema("upto long").option("recursiveFileLookup", "true").parquet(f"{self.path}/marks")
        return marks.where(F.col("upto") < before).agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def _versions(self, before: int) -> DataFrame:
        """Stored rows that hold before batch ``before``, with ``batch``, the batch that wrote them (a base: its last)."""
        base = self._base(before)
        folders = [(b, f"{self.path}/delta/batch={b}") for b in range(base + 1, before)]
        if base >= 0:
            folders.append((base, f"{self.path}/base/upto={base}"))
        out = None
        for batch, folder in folders:
            part = self.spark.read.schema(self.stored).parquet(folder).withColumn("batch", F.lit(batch).cast("long"))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], self.stored).withColumn("batch", F.lit(-1).cast("long"))
        return out

    def _last(self, versions: DataFrame) -> DataFrame:
        whole = F.struct(*[f.name for f in self.schema.fields], "alive")
        last = versions.groupBy(self.key).agg(F.max_by(whole, "batch").alias("row"))
        return last.select("row.*").where("alive").drop("alive")

    def lookup(self, keys: DataFrame, before: int) -> DataFrame:
        """The rows of ``keys`` as they were before batch ``before``."""
        wanted = keys.select(F.col(keys.columns[0]).alias(self.key)).distinct()
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]     # at most BUCKETS numbers
        versions = self._versions(before).where(F.col("bucket").isin(buckets))
        return self._last(versions.join(wanted, self.key, "left_semi"))

    def everything(self, before: int) -> DataFrame:
        return self._last(self._versions(before))

    def put(self, rows: DataFrame, removed: DataFrame, batch: int) -> None:
        """Write the rows that ``batch`` sets and the keys that it removes; a key in both is set."""
        gone = removed.select(F.col(removed.columns[0]).alias(self.key)).distinct().join(rows.select(self.key), self.key, "left_anti")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        both = (rows.select(*self.schema.names, F.lit(True).alias("alive"))
                .unionByName(gone.select(self.key, *empty, F.lit(False).alias("alive"))))
        self._write(both, f"{self.path}/delta/batch={batch}")
        if (batch + 1) % self.compact_every == 0:
            self.compact(batch)

    def compact(self, upto: int) -> None:
        """Write the last version of every key up to batch ``upto``; later lookups start from there."""
        rows = self.everything(upto + 1).withColumn("alive", F.lit(True))
        self._write(rows, f"{self.path}/base/upto={upto}")
        self.spark.createDataFrame([(upto,)], "upto long").write.mode("overwrite").parquet(f"{self.path}/marks/upto-{upto}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = rows.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(folder)
