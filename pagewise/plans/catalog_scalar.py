"""Registered queries: URL, date-time, query-string and credibility functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as T
from ..functions import times as D
from ..functions import urls as U
from ..operators import search as H
from ..sources.tables import table
from .catalog import r6, register, utc

# DuckDB pieces shared by several oracle statements.
NETLOC_SQL = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH_SQL = ("regexp_replace(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), "
            "';[^/]*$', '')")
SCHEME_SQL = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
META_AUTHOR = r'<meta\s+name="author"\s+content="([^"]*)"'
META_DATE = r'<meta\s+property="article:published_time"\s+content="([^"]*)"'
NOW = "2024-03-01 00:00:00"


def _netloc(u="url"):
    return NETLOC_SQL.format(u=u)


def _path(u="url"):
    return PATH_SQL.format(u=u)


def _scheme(u="url"):
    return SCHEME_SQL.format(u=u)


@register("url_domain", f"SELECT page_id, {_netloc()} AS domain FROM pages")
def url_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.netloc("url").alias("domain"))


_P = f"regexp_replace({_path()}, '/+$', '')"


@register("url_filename", f"""
SELECT page_id, replace({_netloc()}, '.', '_') || '_' ||
       CASE WHEN strpos(p, '/') > 0 THEN regexp_extract(p, '[^/]*$', 0) ELSE 'index' END || '_' ||
       substr(md5(p), 1, 8) || '.png' AS filename
FROM (SELECT page_id, url, {_P} AS p FROM pages)
""")
def url_filename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.screenshot_filename("url").alias("filename"))


@register("url_strip_encoded", """
SELECT page_id, regexp_replace(url || '%2Fx%2f%E3%81%82', '%[0-9A-F]{2}', '', 'g') AS stripped FROM pages
""")
def url_strip_encoded(spark: SparkSession, sf: str) -> DataFrame:
    # the suffix puts upper- and lower-case escapes in every URL so both branches are exercised
    return table(spark, sf, "pages").select(
        "page_id", U.strip_encoded(F.concat("url", F.lit("%2Fx%2f%E3%81%82"))).alias("stripped"))


@register("url_valid", f"""
SELECT page_id, coalesce({_scheme()} <> '' AND {_netloc()} <> '', false) AS valid,
       coalesce({_scheme("substr(url, 9)")} <> '' AND {_netloc("substr(url, 9)")} <> '', false) AS valid_cut
FROM pages
""")
def url_valid(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", U.is_well_formed("url").alias("valid"),
                    U.is_well_formed(F.expr("substr(url, 9)")).alias("valid_cut"))


@register("credibility", f"""
SELECT page_id, round(least((
         CASE regexp_extract({_netloc()}, '[^.]*$', 0) WHEN 'gov' THEN 0.3 WHEN 'edu' THEN 0.3 WHEN 'org' THEN 0.1
              ELSE 0.0 END
       + CASE WHEN nullif(regexp_extract(html, '{META_AUTHOR}', 1), '') IS NOT NULL THEN 0.15 ELSE 0.0 END
       + CASE WHEN nullif(regexp_extract(html, '{META_DATE}', 1), '') IS NOT NULL THEN 0.15 ELSE 0.0 END
       + CASE WHEN {_scheme()} = 'https' THEN 0.1 ELSE 0.0 END)::DOUBLE / 1.1, 1.0), 6) AS credibility_score
FROM pages
""")
def credibility(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    author = F.regexp_extract("html", META_AUTHOR, 1)
    date = F.regexp_extract("html", META_DATE, 1)
    return p.select("page_id", r6(S.credibility("url", author, date)).alias("credibility_score"))


@register("page_type", """
SELECT page_id,
       CASE WHEN regexp_matches(url, 'page[-=/]?\\d+') THEN 'page_changer' ELSE 'plane' END AS web_type,
       CASE WHEN regexp_matches(url, 'page[-=/]?\\d+') THEN 2 ELSE 1 END AS priority,
       CAST(nullif(regexp_extract(url, '(page[-=/]?)(\\d+)', 2), '') AS BIGINT) AS page_number
FROM pages
""")
def page_type(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.pagination import web_type, web_type_priority
    p = table(spark, sf, "pages")
    wt = web_type("url")
    return p.select("page_id", wt.alias("web_type"), web_type_priority(wt).alias("priority"),
                    U.page_number("url").alias("page_number"))


from .sql_parts import words_sql  # noqa: E402


@register("cache_key", f"""
SELECT item_id, array_to_string(list_sort({words_sql('lower(text)')}), ' ') AS cache_key FROM benchmark
""")
def cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", T.cache_key("text").alias("cache_key"))


@register("query_variants", """
SELECT DISTINCT item_id, v AS variant FROM (
  SELECT item_id, unnest([text, trim(text), trim(text),
      trim(text || ' best'), trim('best ' || text), trim(text || ' tutorial'), trim('tutorial ' || text),
      trim(text || ' for beginners'), trim('for beginners ' || text), trim(text || ' review'),
      trim('review ' || text), trim(text || ' vs'), trim('vs ' || text),
      'intitle:"' || text || '"', '"' || text || '" site:.gov', '"' || text || '" site:.edu',
      '"' || text || '" filetype:pdf']) AS v
  FROM benchmark)
""")
def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.explode(H.query_variants(F.col("text"))).alias("variant"))


# ---- date-time: every event timestamp written in every supported shape ------------------

_FORMATS_SPARK = [
    ("iso_z", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    ("iso_offset", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"),
    ("iso_naive", "yyyy-MM-dd HH:mm:ss"),
    ("basic_seconds", "yyyyMMdd HH:mm:ss"),
    ("basic_minutes", "yyyyMMdd HH:mm"),
    ("slash_minutes", "yyyy/MM/dd HH:mm"),
    ("date_only", "yyyy-MM-dd"),
    ("us_date", "MM/dd/yyyy"),
    ("slash_date", "yyyy/MM/dd"),
    ("dmy_date", "dd-MM-yyyy"),
    ("time_seconds", "HH:mm:ss"),
    ("time_minutes", "HH:mm"),
]


def _event_strings(spark, sf):
    utc(spark)
    e = table(spark, sf, "events").select("event_id", "ts")
    arr = F.array(*[F.struct(F.lit(n).alias("fmt"), F.date_format("ts", f).alias("s")) for n, f in _FORMATS_SPARK],
                  F.struct(F.lit("empty").alias("fmt"), F.lit("").alias("s")),
                  F.struct(F.lit("garbage").alias("fmt"), F.lit("n/a").alias("s")))
    return e.select("event_id", F.inline(arr))


@register("datetime_parse", """
WITH e AS (SELECT event_id, ts FROM events),
x AS (
  SELECT event_id, 'iso_z' AS fmt, ts AS v, false AS naive FROM e
  UNION ALL SELECT event_id, 'iso_offset', ts, false FROM e
  UNION ALL SELECT event_id, 'iso_naive', date_trunc('second', ts), true FROM e
  UNION ALL SELECT event_id, 'basic_seconds', date_trunc('second', ts), true FROM e
  UNION ALL SELECT event_id, 'basic_minutes', date_trunc('minute', ts), true FROM e
  UNION ALL SELECT event_id, 'slash_minutes', date_trunc('minute', ts), false FROM e
  UNION ALL SELECT event_id, 'date_only', date_trunc('day', ts), true FROM e
  UNION ALL SELECT event_id, 'us_date', date_trunc('day', ts), false FROM e
  UNION ALL SELECT event_id, 'slash_date', date_trunc('day', ts), false FROM e
  UNION ALL SELECT event_id, 'dmy_date', date_trunc('day', ts), false FROM e
  UNION ALL SELECT event_id, 'time_seconds', TIMESTAMP '1900-01-01' + (date_trunc('second', ts) - date_trunc('day', ts)), false FROM e
  UNION ALL SELECT event_id, 'time_minutes', TIMESTAMP '1900-01-01' + (date_trunc('minute', ts) - date_trunc('day', ts)), false FROM e
  UNION ALL SELECT event_id, 'empty', TIMESTAMP '1970-01-01', false FROM e
  UNION ALL SELECT event_id, 'garbage', TIMESTAMP '1970-01-01', false FROM e)
SELECT event_id, fmt, strftime(v, '%Y-%m-%d %H:%M:%S.%f') AS parsed, naive FROM x
""")
def datetime_parse(spark: SparkSession, sf: str) -> DataFrame:
    x = _event_strings(spark, sf)
    p = D.parse_datetime("s")
    return x.select("event_id", "fmt", F.date_format(p["ts"], "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
                    p["naive"].alias("naive"))


@register("scan_age", f"""
WITH e AS (SELECT event_id, ts FROM events)
SELECT event_id, 'iso_z' AS fmt,
       CAST(floor(epoch_us(TIMESTAMP '{NOW}' - ts) / 86400000000.0) AS BIGINT) AS age_days FROM e
UNION ALL SELECT event_id, 'slash_minutes',
       CAST(floor(epoch_us(TIMESTAMP '{NOW}' - date_trunc('minute', ts)) / 86400000000.0) AS BIGINT) FROM e
UNION ALL SELECT event_id, 'iso_naive', CAST(99 AS BIGINT) FROM e
UNION ALL SELECT event_id, 'empty', CAST(99 AS BIGINT) FROM e
""")
def scan_age(spark: SparkSession, sf: str) -> DataFrame:
    x = _event_strings(spark, sf).filter(F.col("fmt").isin("iso_z", "slash_minutes", "iso_naive", "empty"))
    return x.select("event_id", "fmt", D.age_days("s", F.lit(NOW).cast("timestamp")).alias("age_days"))


@register("last_modified", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_modified FROM events
""")
def last_modified(spark: SparkSession, sf: str) -> DataFrame:
    utc(spark)
    e = table(spark, sf, "events")
    header = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return e.select("event_id", D.header_datetime(header).alias("last_modified"))
