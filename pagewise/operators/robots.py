"""robots.txt rules (F5) and the page <-> robots join.

Semantics of the standard-library parser for agent ``*``: comments are cut,
lines split at the first ':'; a ``User-agent`` line that follows rule lines
starts a new group (blank lines do not); the first group naming ``*`` is the
default and the only one that applies; inside it the *first* rule (file order)
whose path is a prefix of the URL path decides; an empty ``Disallow`` allows
everything; no matching rule or no robots file means allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import WS_RUN

_KEYS = ("user-agent", "allow", "disallow", "crawl-delay", "request-rate")


def _strip(c) -> F.Column:
    """Without white space at either end, line breaks and tabs included."""
    return F.regexp_replace(c, f"^{WS_RUN}|{WS_RUN}$", "")


def rules(robots: DataFrame, host: str = "host", text: str = "robots_txt") -> DataFrame:
    """``(host, pos, allow, prefix)`` rules of the default (``*``) group of each file."""
    lines = robots.select(host, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    clean = _strip(F.regexp_replace("line", "#.*", ""))
    colon = F.instr(clean, ":")
    kv = (lines.withColumn("_c", clean).filter(colon > 0)
               .select(host, "pos",
                       F.lower(_strip(F.substring_index("_c", ":", 1))).alias("k"),
                       _strip(F.expr("substr(_c, instr(_c, ':') + 1)")).alias("v"))
               .filter(F.col("k").isin(*_KEYS)))
    w = Window.partitionBy(host).orderBy("pos")
    g = (kv.withColumn("_prev", F.lag("k").over(w))
           .withColumn("grp", F.sum(F.when((F.col("k") == "user-agent")
                                            & (F.col("_prev").isNull() | (F.col("_prev") != "user-agent")), 1)
                                     .otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    star = g.filter((F.col("k") == "user-agent") & (F.col("v") == "*")).groupBy(host).agg(F.min("grp").alias("grp"))
    return (g.join(star, [host, "grp"])
             .filter(F.col("k").isin("allow", "disallow"))
             .select(host, "pos", ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"),
                     F.col("v").alias("prefix")))


def allowed(pages: DataFrame, robots: DataFrame, host: str = "host", url: str = "url") -> DataFrame:
    """F5 + J11: ``allowed`` per page (path of its URL, '/' when empty)."""
    r = rules(robots, host).groupBy(host).agg(
        F.array_sort(F.collect_list(F.struct("pos", "allow", "prefix"))).alias("_rules"))     # no longer than the host's file
    path = F.when(U.path(url) == "", F.lit("/")).otherwise(U.path(url))
    p = pages.join(r, host, "left").withColumn("_path", path)
    first = F.get(F.filter("_rules", lambda x: F.col("_path").startswith(x["prefix"])), F.lit(0))
    return p.withColumn("allowed", F.coalesce(first["allow"], F.lit(True))).drop("_rules", "_path")
