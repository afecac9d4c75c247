"""Tree operators on the flat ``dom_nodes`` table.

Tree walks never recurse.  Subtree aggregates use pre-order prefix sums: a
running sum over ``node_id`` inside a page, read at the subtree's last id and
at the node itself, gives the sum over the descendants with one equi-join.
Subtree *contents* (text, links) are produced only for chosen roots, joining
the node table to one interval per root, so the cost stays O(nodes).
A page's nodes come from one HTML row, so a page is bounded by its HTML size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U

# Layout proxy (X1, our own): viewport width, characters per line, line height,
# indentation per depth and the minimum viewport height.
VIEW_W = 1920.0
VIEW_H = 1080.0
CHARS_PER_LINE = 160
LINE_H = 20.0
CHAR_W = VIEW_W / CHARS_PER_LINE
INDENT = 16.0
INLINE_TAGS = ("a", "abbr", "b", "br", "cite", "code", "em", "i", "img", "label", "q", "s", "small", "span",
               "strong", "sub", "sup", "u")

def elements(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("tag") != "#text")


def css_selector(tag="tag", id_="id", cls="class") -> Column:
    """P9 ``make_css_selector``: ``tag#id``; else tag + ``.c1.c2`` from the class words; else tag."""
    t = F.coalesce(F.col(tag), F.lit(""))
    i = F.coalesce(F.col(id_), F.lit(""))
    classes = T.words(F.coalesce(F.col(cls), F.lit("")))
    with_cls = F.when(F.size(classes) > 0, F.concat(t, F.lit("."), F.array_join(classes, "."))).otherwise(t)
    return F.when(i != "", F.concat(t, F.lit("#"), i)).otherwise(with_cls)


def subtree_metrics(nodes: DataFrame) -> DataFrame:
    """Per element: ``subtree_end``, ``text_len`` (runs joined by single spaces),
    ``n_words``, ``n_links`` (descendant ``<a href>``, self excluded) and
    ``chars_before`` (text characters before the element in document order)."""
    is_text = F.col("tag") == "#text"
    vals = {
        "_len": F.when(is_text, F.length("text")).otherwise(0),
        "_runs": F.when(is_text, 1).otherwise(0),
        "_words": F.when(is_text, T.word_count("text")).otherwise(0),
        "_lnk": F.when((F.col("tag") == "a") & F.col("href").isNotNull() & (F.col("href") != ""), 1).otherwise(0),
    }
    w = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    # one window pass over all rows gives the running sums at every node; elements
    # keep their own columns, so the value "at self" needs no join
    cum = nodes.select("*", *[v.alias(k) for k, v in vals.items()])
    cum = cum.select("*", *[F.sum(k).over(w).alias("c" + k) for k in vals])
    at_end = cum.select("page_id", F.col("node_id").alias("subtree_end"),
                        *[F.col("c" + k).alias("e" + k) for k in vals])
    el = (cum.filter(~is_text)
             .withColumn("subtree_end", F.col("node_id") + F.col("subtree_size") - 1))
    m = el.join(at_end, ["page_id", "subtree_end"])

    def sub(k):   # sum over node..end of the per-node value
        return F.col("e" + k) - F.col("c" + k) + F.col(k)

    runs = F.col("e_runs") - F.col("c_runs")
    m = (m.withColumn("text_len", (sub("_len") + F.greatest(runs - 1, F.lit(0))).cast("int"))
          .withColumn("n_runs", runs.cast("int"))
          .withColumn("n_words", (F.col("e_words") - F.col("c_words")).cast("int"))
          .withColumn("n_links", (sub("_lnk") - F.col("_lnk")).cast("int"))
          .withColumn("chars_before", (F.col("c_len") - F.col("_len")).cast("long")))
    return m.drop(*[p + k for p in ("c", "e", "") for k in vals])


def layout(metrics: DataFrame) -> DataFrame:
    """X1 text-flow layout proxy (ours; never presented as browser geometry).

    Lines = ceil(text_len / 160); height = lines * 20 px; y from the text
    before the element; block elements are indented 16 px per depth level and
    span the rest of a 1920 px viewport, inline elements are as wide as their
    text.  Page height = max(1080, all text lines * 20).  Rows that already
    carry a ``rect`` keep it.
    """
    lines = F.ceil(F.col("text_len") / F.lit(CHARS_PER_LINE))
    x = F.lit(INDENT) * (F.col("depth") - 1)
    block_w = F.greatest(F.lit(VIEW_W) - 2 * x, F.lit(0.0))
    w = F.when(F.col("tag").isin(*INLINE_TAGS), F.least(block_w, F.col("text_len") * F.lit(CHAR_W))).otherwise(block_w)
    y = F.floor(F.col("chars_before") / F.lit(CHARS_PER_LINE)) * F.lit(LINE_H)
    rect = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("width"),
                    (lines * F.lit(LINE_H)).cast("double").alias("height"))
    out = metrics.withColumn("rect", F.coalesce(F.col("rect"), rect) if "rect" in metrics.columns else rect)
    if "page_w" in out.columns and "page_h" in out.columns:
        return out
    page = (out.filter(F.col("parent_id").isNull())
               .groupBy("page_id")
               .agg(F.max(F.greatest(F.lit(VIEW_H), F.ceil(F.col("text_len") / F.lit(CHARS_PER_LINE)) * F.lit(LINE_H)))
                    .cast("double").alias("page_h")))
    return (out.join(page, "page_id", "left")
               .withColumn("page_w", F.lit(VIEW_W))
               .withColumn("page_h", F.coalesce("page_h", F.lit(VIEW_H))))


def prepared_nodes(nodes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Element table ready for scoring: metrics, layout, css selector, url."""
    out = layout(subtree_metrics(nodes)).withColumn("css_selector", css_selector())
    if pages is not None:
        out = out.join(pages.select("page_id", "url"), "page_id", "left")
    return out


def inside_intervals(nodes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Mark nodes lying inside any ``(page_id, start, end)`` interval without
    forming (node, interval) pairs: +1/-1 events and a running sum per page."""
    ev = intervals.select("page_id", F.col("start").alias("_pos"), F.lit(1).alias("_d"), F.lit(0).alias("_is_node")) \
        .unionByName(intervals.select("page_id", (F.col("end") + 1).alias("_pos"), F.lit(-1).alias("_d"),
                                      F.lit(0).alias("_is_node")))
    nd = nodes.select("page_id", F.col("node_id").alias("_pos"), F.lit(0).alias("_d"), F.lit(1).alias("_is_node"))
    w = Window.partitionBy("page_id").orderBy("_pos", "_is_node").rowsBetween(Window.unboundedPreceding, 0)
    cover = (ev.unionByName(nd).withColumn("_cover", F.sum("_d").over(w))
               .filter(F.col("_is_node") == 1)
               .select("page_id", F.col("_pos").alias("node_id"), (F.col("_cover") > 0).alias("_inside")))
    return nodes.join(cover, ["page_id", "node_id"])


def prune_subtrees(nodes: DataFrame, bad: Column) -> DataFrame:
    """Drop every node that matches ``bad`` together with its subtree."""
    roots = nodes.filter(bad).select("page_id", F.col("node_id").alias("start"),
                                     (F.col("node_id") + F.col("subtree_size") - 1).alias("end"))
    return inside_intervals(nodes, roots).filter(~F.col("_inside")).drop("_inside")


def in_subtree(nodes: DataFrame, roots: DataFrame, root: str = "root_id", end: str = "root_end") -> DataFrame:
    """Nodes inside each root's interval (equi on page, range on id)."""
    r = roots.withColumnRenamed("page_id", "_rpage").alias("_r")
    n = nodes.alias("_n")
    cond = ((F.col("_n.page_id") == F.col("_r._rpage")) & (F.col("_n.node_id") >= F.col(f"_r.{root}"))
            & (F.col("_n.node_id") <= F.col(f"_r.{end}")))
    return n.join(r, cond).drop("_rpage")


def subtree_text(nodes: DataFrame, roots: DataFrame, root: str = "root_id", end: str = "root_end") -> DataFrame:
    """Text of each root = its descendant text runs in document order joined by one space."""
    runs = nodes.filter(F.col("tag") == "#text").select("page_id", "node_id", "text")
    j = in_subtree(runs, roots, root, end)
    agg = j.groupBy("page_id", root).agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("_r"))
    return agg.select("page_id", root, F.array_join(F.transform("_r", lambda s: s["text"]), " ").alias("text"))


def subtree_links(nodes: DataFrame, roots: DataFrame, pages: DataFrame, root: str = "root_id",
                  end: str = "root_end") -> DataFrame:
    """A10: absolute hrefs of descendant ``<a>`` (root excluded), non-empty, sorted, duplicates kept."""
    a = nodes.filter((F.col("tag") == "a") & F.col("href").isNotNull() & (F.col("href") != "")) \
             .select("page_id", "node_id", "href")
    j = in_subtree(a, roots, root, end).filter(F.col("node_id") != F.col(root))
    j = j.join(pages.select("page_id", "url"), "page_id").withColumn("abs", U.resolve("url", "href"))
    agg = j.groupBy("page_id", root).agg(F.sort_array(F.collect_list("abs")).alias("links"))
    return (roots.select("page_id", root).join(agg, ["page_id", root], "left")
                 .withColumn("links", F.coalesce("links", F.array().cast("array<string>"))))

