"""Operators of the legacy detector variant and small helpers it used
(F6, F14, F15, L6, A12, P27).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom as DOM
from .selectors import legacy_selector

# Elements that never count as visible content.
INVISIBLE_TAGS = ("META", "SCRIPT", "LINK", "STYLE", "IFRAME")
SKIP_TOLERANCE_PX = 5.0


def matches_criteria(tag: str | None = None, id_: str | None = None, attributes: dict | None = None) -> Column:
    """every given criterion equals the node's value."""
    cond = F.lit(True)
    if tag:
        cond = cond & (F.col("tag") == tag)
    if id_:
        cond = cond & (F.col("id") == id_)
    for k, v in (attributes or {}).items():
        cond = cond & F.coalesce(F.try_element_at("attributes", F.lit(k)) == v, F.lit(False))
    return cond


def choice_content(prepared: DataFrame, tag: str | None = None, id_: str | None = None,
                   attributes: dict | None = None) -> DataFrame:
    """L6 ``choice_content``: the criteria selector (P23) and the matching elements.

    The legacy walk prunes a subtree at the first node that fails the
    criteria, starting from ``body``; a node is reachable only if all its
    ancestors below body match.  Pruning uses interval coverage (F6/F12), so no
    ancestor pairs are formed.
    """
    ok = matches_criteria(tag, id_, attributes)
    body_or_ok = F.col("parent_id").isNull() | ok
    kept = DOM.prune_subtrees(prepared, ~body_or_ok)
    sel = legacy_selector(F.lit(tag or ""), F.lit(id_ or ""),
                          F.create_map(*[x for kv in (attributes or {}).items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
                          if attributes else F.create_map().cast("map<string,string>"))
    return kept.filter(ok).withColumn("selector", sel)


def is_visible_element(tag="tag", visible="visible", opacity="opacity", z_index="z_index", rect="rect",
                       view_w: float = 1920.0, view_h: float = 1080.0) -> Column:
    """F14 (legacy, uncalled in the reference): for snapshots that carry style columns."""
    r = F.col(rect)
    z = F.col(z_index)
    z_ok = (z == "auto") | (F.coalesce(z.try_cast("int"), F.lit(0)) >= 0)
    intersects = ((r["x"] + r["width"] > 0) & (r["y"] + r["height"] > 0) & (r["x"] < view_w) & (r["y"] < view_h))
    return (~F.upper(F.col(tag)).isin(*INVISIBLE_TAGS) & F.coalesce(F.col(visible), F.lit(False))
            & (F.coalesce(F.col(opacity).cast("double"), F.lit(1.0)) != 0) & z_ok & intersects)


def skippable(prepared: DataFrame) -> DataFrame:
    """F15 (legacy, uncalled): elements with exactly one child whose box differs by < 5 px on all four values."""
    kids = prepared.filter(F.col("parent_id").isNotNull()).select(
        "page_id", F.col("parent_id").alias("node_id"), F.col("rect").alias("_crect"))
    one = kids.groupBy("page_id", "node_id").agg(F.count(F.lit(1)).alias("_n"), F.first("_crect").alias("_crect")) \
              .filter("_n = 1")
    j = prepared.join(one, ["page_id", "node_id"])
    close = None
    for f in ("x", "y", "width", "height"):
        c = F.abs(F.col("rect")[f] - F.col("_crect")[f]) < SKIP_TOLERANCE_PX
        close = c if close is None else close & c
    return j.filter(close).drop("_n", "_crect")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A12 ``remove_duplicate_ports``: the set of values."""
    return df.select(col).distinct()


def page_dimensions(*measures: str) -> Column:
    """The largest of the page's width (or height) measures."""
    return F.greatest(*[F.col(m) for m in measures])
