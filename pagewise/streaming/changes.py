"""Continuous change detection on Structured Streaming.

A stream of page snapshots ``(page_id, url, html)`` is processed per micro-batch with ``foreachBatch``.  A batch is one
monitoring run (C5) over the watch rows of the pages it brings: their state is looked up in a keyed table, a page without
state starts as a new row, and only rows that the run changed are written back.  Change and error rows are written
under the batch's number, so that a batch run again after a failure writes what it wrote before.

The state has one row per URL.  A run may move a row to another URL (pagination): the old key is removed.  Of several
snapshots of a URL in one batch the one with the largest ``page_id`` counts; the others are of no use to anyone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import monitoring as MON
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.watchlist import WATCH_SCHEMA, normalize
from .state import KeyedTable

CHANGE_COLS = ["url", "new_url", "result_vl", "is_new"]


def newest_snapshots(batch: DataFrame) -> DataFrame:
    """One snapshot per URL of a batch."""
    pages = batch.where(F.col("url").isNotNull() & (F.col("url") != ""))
    best = pages.groupBy("url").agg(F.max_by(F.struct("page_id", "html"), "page_id").alias("p"))
    return best.select("p.page_id", "url", "p.html")


class ChangeDetector:
    """foreachBatch sink: the state in ``base/state``, change and error rows in ``base/changes`` and ``base/errors``."""

    def __init__(self, spark: SparkSession, base: str, now: Column | None = None, robots: DataFrame | None = None,
                 compact_every: int = 20):
        self.spark, self.base, self.now, self.robots = spark, base.rstrip("/"), now, robots
        self.state = KeyedTable(spark, f"{self.base}/state", WATCH_SCHEMA, "url", compact_every=compact_every)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.now if self.now is not None else F.lit(self.spark.sql("select current_timestamp()").first()[0])
        pages = cut_lineage(newest_snapshots(batch))
        known = self.state.lookup(pages.select("url"), batch_id).drop("row_id")
        watch = pages.select(F.col("page_id").alias("row_id"), "url").join(
            known.withColumn("is_known", F.lit(True)), "url", "left")
        watch = cut_lineage(watch)
        is_new = watch.select("row_id", F.col("is_known").isNull().alias("is_new"), F.col("url").alias("old_url"))
        before = normalize(watch.drop("is_known"))
        new, changed, errors = MON.monitoring_run(before, pages, now, robots=self.robots)
        new = cut_lineage(new)
        moved = new.join(is_new, "row_id")
        gone = moved.where("old_url != url").select("old_url")
        # several rows may have moved to one URL: the one with the largest id is its state from now on
        rows = new.groupBy("url").agg(F.max_by(F.struct(*new.columns), "row_id").alias("r")).select("r.*")
        self.state.put(self._differing(rows, before), gone, batch_id)
        told = (changed.select("row_id").join(moved, "row_id")
                .select(F.col("old_url").alias("url"), F.col("url").alias("new_url"), "result_vl", "is_new"))
        told.write.mode("overwrite").parquet(f"{self.base}/changes/batch_id={batch_id}")
        errors.select("url", "message").write.mode("overwrite").parquet(f"{self.base}/errors/batch_id={batch_id}")

    @staticmethod
    def _differing(rows: DataFrame, before: DataFrame) -> DataFrame:
        """Rows that differ from the state they had; the run code, stamped on all, is no difference."""
        cols = [c for c in WATCH_SCHEMA.names if c not in ("row_id", "run_code")]
        old = before.select("row_id", F.struct(*cols).alias("old"))
        return rows.join(old, "row_id", "left").where(~F.struct(*cols).eqNullSafe(F.col("old"))).drop("old")


def start(spark: SparkSession, source_dir: str, schema: str = "page_id long, url string, html string",
          base: str | None = None, now=None, available_now: bool = True, max_files_per_trigger: int | None = None,
          file_glob: str | None = None, robots: DataFrame | None = None, compact_every: int = 20):
    """Start the change-detection stream over parquet snapshot files in ``source_dir``
    (optionally only files matching ``file_glob``).  Started again with the same ``base``, it goes on where it was."""
    root = base or f"{ensure_checkpoint_dir(spark, allow_local_default=spark.sparkContext.master.startswith('local'))}/x2-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    sink = ChangeDetector(spark, root, now, robots, compact_every)
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(), root


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/changes")
