"""Search-hit operators: query variants (P13), backend fallback (S8), hit dedupe
(A2/U1), TTL cache lookup (J6/F11), content enrichment (J7/P14) and reciprocal
rank fusion (A7/J8/U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

# Query modifiers and operator templates of the query enhancer.
QUERY_MODIFIERS = ["", "best", "tutorial", "for beginners", "review", "vs"]
INTITLE_TEMPLATE = 'intitle:"{q}"'
HIGH_CREDIBILITY_TEMPLATES = ['"{q}" site:.gov', '"{q}" site:.edu', '"{q}" filetype:pdf']
# Fixed value: backend order of the search client.
BACKENDS = ["html", "lite", "bing"]
RRF_K = 60
CACHE_TTL_S = 3600


def _template(tpl: str, q: Column) -> Column:
    pre, post = tpl.split("{q}")
    return F.concat(F.lit(pre), q, F.lit(post))


def query_variants(base: Column, high_credibility_sources: bool = True) -> Column:
    """Distinct set of query variants as an array (15 with the flag, 12 without,
    fewer when variants coincide)."""
    parts = [base]
    for m in QUERY_MODIFIERS:
        parts.append(F.trim(F.concat(base, F.lit(" " + m))) if m else F.trim(base))
        parts.append(F.trim(F.concat(F.lit(m + " "), base)) if m else F.trim(base))
    parts.append(_template(INTITLE_TEMPLATE, base))
    if high_credibility_sources:
        parts += [_template(t, base) for t in HIGH_CREDIBILITY_TEMPLATES]
    return F.array_distinct(F.array(*parts))


def backend_fallback(hits: DataFrame, query: str = "q", backend_priority: str = "backend_priority",
                     pos: str = "pos", max_results: int = 50) -> DataFrame:
    """Per query keep only the first backend (lowest priority value) that
    returned rows, and at most ``max_results`` of its rows (the search cap)."""
    best = hits.groupBy(query).agg(F.min(backend_priority).alias("_best"))
    return (hits.join(best, query)
                .filter((F.col(backend_priority) == F.col("_best")) & (F.col(pos) <= max_results))
                .drop("_best"))


def dedupe_hits(hits: DataFrame, keys: list[str], href: str, seq: str) -> DataFrame:
    """A2: one row per ``href``: values of the last row (highest ``seq``) win,
    the position is the first one (lowest ``seq``).  Map-side partial
    aggregation keeps a hot href from reaching one task whole."""
    cols = [c for c in hits.columns if c not in (*keys, href, seq)]
    agg = hits.groupBy(*keys, href).agg(
        F.min(seq).alias(seq),
        F.max_by(F.struct(*cols), F.col(seq)).alias("_last"))
    return agg.select(*keys, href, seq, *[F.col("_last")[c].alias(c) for c in cols])


def cache_lookup(requests: DataFrame, cache: DataFrame, key: str, ts: str, set_at: str,
                 ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """J6 + F11 as-of lookup: for each request find the latest cache entry with the
    same key and ``set_at <= ts``; it is a hit iff ``ts < set_at + ttl``.  Requests
    come back with ``cache_set_at``, ``cache_ttl_s`` and ``cache_hit``."""
    ent = cache.select(F.col(key).alias("_k"), F.col(set_at).cast("timestamp").alias("_t"), F.lit(True).alias("_is_set"))
    rq = requests.select(F.col(key).alias("_k"), F.col(ts).cast("timestamp").alias("_t"), F.lit(False).alias("_is_set"),
                         F.struct(*requests.columns).alias("_req"))
    ent = ent.withColumn("_req", F.lit(None).cast(rq.schema["_req"].dataType))
    return _as_of(ent.unionByName(rq), ttl_s)


def cache_replay(events: DataFrame, key: str, ts: str, is_entry: Column, is_request: Column,
                 ttl_s: int = CACHE_TTL_S) -> DataFrame:
    """:func:`cache_lookup` over one log of entries and requests, read once: its request rows."""
    log = events.select(F.col(key).alias("_k"), F.col(ts).cast("timestamp").alias("_t"), is_entry.alias("_is_set"),
                        is_request.alias("_asked"), F.struct(*events.columns).alias("_req"))
    return _as_of(log.where("_is_set or _asked").drop("_asked"), ttl_s)


def _as_of(log: DataFrame, ttl_s: int) -> DataFrame:
    """The cache as a walk along time: at each request the latest entry of its key is known and older ones are gone.

    Time is cut into buckets as long as an entry lives, and an entry is put into its own bucket and the next one: past
    that it has expired and is dropped.  So one window over (key, bucket) is enough, a hot key is spread over its
    buckets, and neither requests nor entries are read or shuffled twice."""
    ttl = F.lit(int(ttl_s) * 1_000_000)
    own = F.floor(F.unix_micros("_t") / ttl).cast("long")
    placed = log.withColumn("_b", F.explode(F.when(F.col("_is_set"), F.array(own, own + 1)).otherwise(F.array(own))))
    # entries at the same instant as a request are visible to it (set_at <= ts)
    w = (Window.partitionBy("_k", "_b").orderBy(F.col("_t").asc(), F.col("_is_set").desc())
         .rowsBetween(Window.unboundedPreceding, 0))
    latest = F.max(F.when(F.col("_is_set"), F.col("_t"))).over(w)
    out = placed.withColumn("cache_set_at", latest).where("not _is_set")
    live = F.unix_micros("_t") < F.unix_micros("cache_set_at") + ttl
    return (out.select("_req.*", "cache_set_at", F.lit(int(ttl_s)).alias("cache_ttl_s"),
                       F.coalesce(live, F.lit(False)).alias("cache_hit")))


def enrich_hits(hits: DataFrame, content: DataFrame | None, href: str = "href") -> DataFrame:
    """J7 + P14: left join hits with extracted content on href.

    When content exists its text replaces the body and its credibility is
    computed from the final URL and metadata; missing content gives 0.0.
    """
    if content is None:
        return hits.withColumn("credibility_score", F.lit(0.0))
    c = content.select(
        F.col("url").alias(href), F.col("text").alias("_ctext"),
        F.struct("author", "date", "sitename").alias("extracted_metadata"),
        S.credibility(F.coalesce("final_url", "url"), "author", "date").alias("_cred"),
        F.lit(True).alias("_has_content"))
    out = hits.join(c, href, "left")
    return (out.withColumn("body", F.when(F.col("_has_content"), F.coalesce("_ctext", "body")).otherwise(F.col("body")))
               .withColumn("credibility_score", F.when(F.col("_has_content"), F.col("_cred")).otherwise(F.lit(0.0)))
               .drop("_ctext", "_cred", "_has_content"))


def rrf(ranked_lists: list[DataFrame], keys: list[str], k: int = RRF_K, rank: str = "rank") -> DataFrame:
    """Sum over lists of 1/(k + rank + 1) with 0-based ranks, per key.
    Lists are unioned and summed (no join); rows with a null key are skipped."""
    parts = [l.select(*keys, (1.0 / (F.lit(k) + F.col(rank) + 1)).alias("_rr")) for l in ranked_lists]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    cond = None
    for c in keys:
        cond = F.col(c).isNotNull() if cond is None else cond & F.col(c).isNotNull()
    return u.filter(cond).groupBy(*keys).agg(F.sum("_rr").alias("rrf_score"))
