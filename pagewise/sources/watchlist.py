"""Watch-list sources and sinks (S1, S2, S3) and snapshot sink.

The watch list is a table with an explicit ``row_id`` (the reference relies on
row position).  Missing columns are added, nulls become '' and a missing
selector list becomes an empty array.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rank import positions

WATCH_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("run_code", T.StringType()),
    T.StructField("result_vl", T.StringType()),
    T.StructField("updated_datetime", T.StringType()),
    T.StructField("full_scan_datetime", T.StringType()),
    T.StructField("css_selector_list", T.ArrayType(T.StringType())),
    T.StructField("web_page_type", T.StringType()),
    T.StructField("image_filename", T.StringType()),
])
STRING_COLS = ["url", "run_code", "result_vl", "updated_datetime", "full_scan_datetime", "web_page_type",
               "image_filename"]
# Fixed value: column order of the headerless legacy CSV.
LEGACY_CSV_COLUMNS = ["url", "run_code", "result_vl", "updated_datetime", "full_scan_datetime",
                      "css_selector_list", "web_page_type"]


def normalize(df: DataFrame) -> DataFrame:
    """S1 defaults: add missing columns, '' for nulls, [] for a missing selector list."""
    for f in WATCH_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in WATCH_SCHEMA.fields])
    out = out.fillna("", subset=[c for c in STRING_COLS if c != "url"])
    return out.withColumn("css_selector_list", F.coalesce("css_selector_list", F.array().cast("array<string>")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, in one file or in the part files that :func:`write_json` makes of one.  A record
    without ``row_id`` takes its position in the array.  An absent file, or one that is no JSON array, gives an empty
    watch list."""
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return normalize(spark.createDataFrame([], WATCH_SCHEMA))
    array = F.from_json("value", T.ArrayType(WATCH_SCHEMA))
    first = r"\A\[\n"
    texts = texts.select("value", F.when(F.col("value").rlike(r"\A\s*\["), array).alias("records"))
    whole = (texts.where("records is not null").select(F.posexplode("records").alias("pos", "r"))
             .select(F.coalesce("r.row_id", F.col("pos").cast("long")).alias("row_id"), F.struct("r.*").dropFields("row_id").alias("r"))
             .where("r is not null").select("row_id", "r.*"))
    if texts.where(F.col("value").rlike(first) & F.col("records").isNull()).isEmpty():
        return normalize(whole)
    # parts of one array: a record a line
    lines = spark.read.text(path).where(F.col("value").rlike(r"^,?\{.*\}$"))
    part = F.from_json(F.regexp_replace("value", "^,", ""), WATCH_SCHEMA)
    return normalize(lines.select(part.alias("r")).where("r is not null").select("r.*"))


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 7-column CSV; the selector is one string; page type '0.0' means none; ``row_id`` is the row's
    position in the file (of several files, in the order of their names), however Spark splits it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in LEGACY_CSV_COLUMNS])
    df = spark.read.schema(schema).csv(path, header=False)
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
                   F.monotonically_increasing_id().alias("_seq"))
    df = positions(df, ["_file", "_at", "_seq"], "row_id").drop("_file", "_at", "_seq")
    df = (df.withColumn("css_selector_list",
                        F.when(F.coalesce(F.col("css_selector_list"), F.lit("")) == "", F.array().cast("array<string>"))
                        .otherwise(F.array("css_selector_list")))
            .withColumn("web_page_type", F.when(F.col("web_page_type").isin("0.0", ""), F.lit(""))
                        .otherwise(F.col("web_page_type"))))
    return normalize(df)


def stamp_run(df: DataFrame, run_code) -> DataFrame:
    """S3: the same run code on every row."""
    return df.withColumn("run_code", run_code if not isinstance(run_code, str) else F.lit(run_code))


def write_json(df: DataFrame, path: str) -> None:
    """S3: one JSON array in ``row_id`` order, a record a line.  Its part files, read in the order of their names, are
    the document; :func:`read_json` reads the folder back as it was."""
    least = df.agg(F.min(F.coalesce("row_id", F.lit(-1)))).first()[0]
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    pos = F.coalesce("row_id", F.lit(-1))
    comma = F.when(pos == F.lit(least), F.lit("")).otherwise(F.lit(","))
    rows = df.select(F.lit(1).alias("section"), pos.alias("pos"), F.concat(comma, record).alias("value"))
    spark = df.sparkSession
    frame = spark.createDataFrame([(0, 0, "["), (2, 0, "]")], "section int, pos long, value string")
    ordered = rows.unionByName(frame).repartitionByRange("section", "pos").sortWithinPartitions("section", "pos")
    ordered.select("value").write.mode("overwrite").text(path)


def latest_per_domain(snapshots: DataFrame, domain: str = "domain", order: str = "scanned_at") -> DataFrame:
    """The last snapshot of each domain wins (``max_by`` aggregates map-side,
    so a domain with very many snapshots is reduced before the shuffle)."""
    cols = [c for c in snapshots.columns if c != domain]
    best = snapshots.groupBy(domain).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_s"))
    return best.select(domain, *[F.col("_s")[c].alias(c) for c in cols])


def write_snapshots(snapshots: DataFrame, path: str, domain: str = "domain", order: str = "scanned_at") -> None:
    """S4 sink: one JSON document per domain (latest), partitioned by domain."""
    latest_per_domain(snapshots, domain, order).write.mode("overwrite").partitionBy(domain).json(path)
