"""Page type and pagination.

Links are arrays on the page row; the newest page is found with array
functions (no explode), so the work stays inside one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import cut_lineage

# Page types and their priorities.
WEB_TYPES = {"plane": 1, "page_changer": 2, "not_quickscan": 3}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def web_type(url) -> Column:
    """``page_changer`` when the URL is paginated, else ``plane``."""
    return F.when(U.is_paginated(url), F.lit("page_changer")).otherwise(F.lit("plane"))


def web_type_from_string(s) -> Column:
    """P16 ``WebType.from_string``: text after the last '.', stripped; unknown -> plane."""
    name = F.trim(F.substring_index(_c(s), ".", -1))
    return F.when(name.isin(*WEB_TYPES), name).otherwise(F.lit("plane"))


def web_type_priority(t) -> Column:
    expr = F.lit(None).cast("int")
    for n, p in WEB_TYPES.items():
        expr = F.when(_c(t) == n, F.lit(p)).otherwise(expr)
    return expr


def merge_web_type(current, previous) -> Column:
    """P16 priority merge: the current type only if its priority is strictly higher."""
    cur, prev = web_type_from_string(current), web_type_from_string(previous)
    return F.when(_c(previous).isNull() | (_c(previous) == ""), cur).when(
        web_type_priority(cur) > web_type_priority(prev), cur).otherwise(prev)


def newest_page_link(base_url, links) -> Column:
    """A9 ``determine_watch_page``: the link with the highest page number (first in
    list order on ties), resolved against the base, if that number is greater
    than the base URL's; null otherwise."""
    b = _c(base_url)
    numbered = F.filter(
        F.transform(F.coalesce(_c(links), F.array().cast("array<string>")),
                    lambda l, i: F.struct(U.page_number(l).alias("n"), (-i).alias("neg_pos"), l.alias("link"))),
        lambda s: s["n"].isNotNull())
    best = F.array_max(numbered)
    base_n = F.coalesce(U.page_number(b), F.lit(-1))
    return F.when(U.is_paginated(b) & best.isNotNull() & (best["n"] > base_n), U.resolve(b, best["link"]))


def next_url(base_url, links) -> Column:
    """``typechk``/``webtype_chk`` next URL: A9 result when it differs from the base."""
    n = newest_page_link(base_url, links)
    return F.when(n != _c(base_url), n)


def should_check_update(base_url, links) -> Column:
    """paginated base URL and some link with ``page-N``/``page=N``."""
    has = F.exists(F.coalesce(_c(links), F.array().cast("array<string>")),
                   lambda l: l.rlike(U.PAGINATION_LINK_PATTERN))
    return U.is_paginated(base_url) & has


def follow_chain(requests: DataFrame, pages: DataFrame, max_hops: int = 3, url: str = "url", nxt: str = "next_url") -> DataFrame:
    """J5 with the robots gate (J11): from each request's ``url`` follow ``pages``' next URL up to ``max_hops`` times.

    ``pages`` has one row per URL with ``next_url`` and, if robots rules apply, ``allowed``.  Returns the requests with
    ``final_url`` (the last page reached), ``hops`` and ``chain_ok``, false when the first page or a hop is blocked or
    not among ``pages``; what such a page links to is not followed.  Only rows that still have a next URL take part in a
    hop, so null URLs are in no join, and the hops end with the last of them."""
    gate = F.coalesce(F.col("allowed"), F.lit(True)) if "allowed" in pages.columns else F.lit(True)
    look = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("final_url"), F.col(nxt).alias("_next"), gate.alias("_open"))
    front = requests.withColumn("final_url", F.col(url)).withColumn("hops", F.lit(0))
    keep, out = front.columns, None
    for hop in range(max_hops + 1):
        met = front.join(look, "final_url", "left").withColumn("chain_ok", F.coalesce("_open", F.lit(False)))
        met = cut_lineage(met)
        goes = F.col("chain_ok") & F.col("_next").isNotNull() & F.lit(hop < max_hops)
        done = met.where(~goes).select(*keep, "chain_ok")
        out = done if out is None else out.unionByName(done)
        front = (met.where(goes).withColumn("final_url", F.col("_next")).withColumn("hops", F.lit(hop + 1)).select(*keep))
        if hop == max_hops or front.isEmpty():
            break
    return out
