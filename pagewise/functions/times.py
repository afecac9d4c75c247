"""Date-time column functions (P4 parse, P5 now-string, P6 header date, P8 age).

All timestamps are UTC (session time zone UTC).  ``parse_datetime`` returns a
struct ``(ts, naive)``: ISO strings without an offset parse as wall time and are
flagged naive, which makes the age undefined (the scan-age rule then uses 99).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"
DEFAULT_AGE_DAYS = 99

# Every ISO shape: basic or extended date and time, hours alone, any number of fraction digits, offsets of three lengths.
ISO_ANY = (r"^(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
           r"(Z|[+-]\d{2}(?::?\d{2})?)?)?\z")
# The parts of a match in one order, the offset behind '#'; a digit after the fraction stands for an absent one.
ISO_PARTS = "@$1-$3-$4 $5:$7:$8.$90#$10"

# The legacy formats that no ISO shape covers, as the shapes of their digits:
# year/month/day with a time, month/day/year, year/month/day, day-month-year, times alone.
LEGACY_SHAPES = ("0000/00/00 00:00", "00/00/0000", "0000/00/00", "00-00-0000", "00:00:00", "00:00")
TIME_ONLY_DATE = "1900-01-01 "


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _legacy_text(x: Column) -> Column:
    """The date and time text of a legacy format, null for any other shape."""
    shape = F.translate(x, "0123456789", "0000000000")
    year_last = F.concat_ws("-", F.substring(x, 7, 4), *(F.substring(x, i, 2) for i in (1, 4)))
    day_first = F.concat_ws("-", F.substring(x, 7, 4), *(F.substring(x, i, 2) for i in (4, 1)))
    dashed = F.replace(x, F.lit("/"), F.lit("-"))
    texts = (F.concat(dashed, F.lit(":00")), year_last, dashed, day_first,
             F.concat(F.lit(TIME_ONLY_DATE), x), F.concat(F.lit(TIME_ONLY_DATE), x, F.lit(":00")))
    out = F.lit(None).cast("string")
    for name, text in zip(LEGACY_SHAPES, texts):
        out = F.when(shape == name, text).otherwise(out)
    return out


def parse_datetime(s) -> Column:
    """P4 ``safe_parse_datetime`` -> struct<ts: timestamp, naive: boolean>.

    A text is matched once: its ISO parts are put in one order by one replacement, absent ones filled in by plain
    ones, and whatever it is, one cast makes the timestamp.  The expression stays small enough to be compiled
    wherever it is used."""
    x = _c(s)
    iso = F.regexp_replace(x, ISO_ANY, ISO_PARTS)
    is_iso = iso.startswith("@") & ~x.startswith("@")
    zone = F.substring_index(iso, "#", -1)
    text = F.substring_index(F.substring(iso, 2, 64), "#", 1)
    for gap, filled in ((" :", " 00:"), ("::", ":00:"), (":.", ":00.")):
        text = F.replace(text, F.lit(gap), F.lit(filled))
    ts = F.when(is_iso, F.concat(text, zone)).otherwise(_legacy_text(x)).try_cast("timestamp")
    return F.struct(F.coalesce(ts, F.lit(EPOCH).cast("timestamp")).alias("ts"),
                    F.coalesce(is_iso & (zone == "") & ts.isNotNull(), F.lit(False)).alias("naive"))


def iso_utc_string(ts) -> Column:
    """P5 ``get_Strdatetime`` for a given instant: ISO 8601 with ``Z``."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def header_datetime(h) -> Column:
    """RFC-1123 header date -> ``yyyy-MM-dd HH:mm:ss`` (zone ignored), null if unparsable."""
    core = F.regexp_extract(_c(h), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return F.date_format(F.try_to_timestamp(core, F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd HH:mm:ss")


def age_days(full_scan, now) -> Column:
    """Whole days since the last full scan, floored; 99 when empty or naive."""
    s = _c(full_scan)
    p = parse_datetime(s)
    days = F.floor((F.unix_micros(_c(now)) - F.unix_micros(p["ts"])) / F.lit(86_400_000_000)).cast("long")
    return F.when((F.coalesce(s, F.lit("")) == "") | p["naive"], F.lit(DEFAULT_AGE_DAYS).cast("long")).otherwise(days)
