"""Spark session helpers.

``local_session`` is for tests and the benchmark only.  Library code never
creates a session; it receives one (or a DataFrame) from the caller.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "pagewise",
                  driver_memory: str = "16g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local_default=True)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, allow_local_default: bool = False) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system).  Only local test sessions may fall back to a fresh temporary
    folder, and only when the setting is absent.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if not path:
        if not allow_local_default:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
        path = tempfile.mkdtemp(prefix="pagewise-ckpt-", dir=os.environ.get("PAGEWISE_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession, allow_local_default=_is_local(df.sparkSession))
    return df.checkpoint(eager=True)


def one_table(df):
    """A union of many checkpointed tables in no more partitions than a shuffle has."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written(df, label: str = "table"):
    """Cut the lineage with a table written to the shared folder; later reads of it are pruned and pushed down."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark, allow_local_default=_is_local(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df, key: str, sort: list[str], label: str):
    """Write ``df`` to the shared folder bucketed by ``key`` and sorted, one file a bucket.  Joins, windows and
    aggregates by ``key`` then need no exchange of this side, and only the columns they name are read."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark, allow_local_default=_is_local(spark)).rstrip('/')}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, key).sortWithinPartitions(*sort)
    placed.write.format("parquet").option("path", path).bucketBy(n, key).sortBy(*sort).saveAsTable(name)
    return spark.table(name)


#: A table is broadcast only when its counted rows times their width stay below this.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df, row_bytes: int):
    """``broadcast`` a table that is cheap to count when its row count proves it small; else leave the join to Spark."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


_SHIPPED: set = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``pagewise`` importable by the Python workers (for its pandas UDFs).

    On a cluster the package is normally shipped with ``--py-files``; when the
    workers cannot import it, the driver's copy is zipped once per application
    and added with ``addPyFile`` (Spark serves it to every executor)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    import zipfile

    import pagewise
    root = os.path.dirname(os.path.dirname(os.path.abspath(pagewise.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="pagewise-pkg-"), "pagewise.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(os.path.join(root, "pagewise")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(key)
