"""CSS selector matching against ``dom_nodes``.

Selectors are the simple compound form the library itself generates
(``tag``, ``#id``, ``.class`` parts and ``[attr='value']`` tests).  They are
compiled into a struct by regular expressions, and matched with an equi-join
on the page and the selector's most selective part (id, class, attribute or
tag) plus a filter.  Constant selectors are column tests and need no join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_ATTR = r"\[\s*([^=\]\s]+)\s*(?:=\s*['\"]?([^'\"\]]*)['\"]?)?\s*\]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compile_selector(sel) -> Column:
    """struct<tag, id, classes array, attr_keys array, attr_vals array>."""
    s = F.trim(_c(sel))
    base = F.regexp_replace(s, r"\[[^\]]*\]", "")
    return F.struct(
        F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9-]*)", 1)).alias("tag"),
        F.regexp_extract(base, r"#([^.#\s]+)", 1).alias("id"),
        F.regexp_extract_all(base, F.lit(r"\.([^.#\s]+)"), 1).alias("classes"),
        F.regexp_extract_all(s, F.lit(_ATTR), 1).alias("attr_keys"),
        F.regexp_extract_all(s, F.lit(_ATTR), 2).alias("attr_vals"),
    )


def matches(sel: Column, tag="tag", id_="id", cls="class", attributes="attributes") -> Column:
    """Does the node satisfy every part of the compiled selector?"""
    node_classes = T.words(F.coalesce(_c(cls), F.lit("")))
    attrs = F.coalesce(_c(attributes), F.create_map().cast("map<string,string>"))
    attr_ok = F.forall(F.arrays_zip(sel["attr_keys"].alias("k"), sel["attr_vals"].alias("v")),
                       lambda e: F.when(e["v"] == "", F.map_contains_key(attrs, e["k"]))
                       .otherwise(F.coalesce(F.try_element_at(attrs, e["k"]) == e["v"], F.lit(False))))
    return ((sel["tag"] == "") | (F.lower(_c(tag)) == sel["tag"])) & \
           ((sel["id"] == "") | (F.coalesce(_c(id_), F.lit("")) == sel["id"])) & \
           (F.size(F.array_except(sel["classes"], node_classes)) == 0) & attr_ok


def constant_selector(sel: str) -> Column:
    """The test of a selector that is known when the plan is made, on a node's ``tag, id, class, attributes``."""
    base = re.sub(r"\[[^\]]*\]", "", sel.strip())
    tag, name = re.match(r"[A-Za-z][A-Za-z0-9-]*", base), re.search(r"#([^.#\s]+)", base)
    test = F.col("tag") != "#text"
    if tag:
        test = test & (F.lower("tag") == tag.group().lower())
    if name:
        test = test & F.col("id").eqNullSafe(F.lit(name.group(1)))
    for c in re.findall(r"\.([^.#\s]+)", base):
        test = test & F.array_contains(T.words(F.coalesce("class", F.lit(""))), c)
    for key, value in re.findall(_ATTR, sel):
        held = F.try_element_at("attributes", F.lit(key))
        test = test & (held.isNotNull() if value == "" else held.eqNullSafe(F.lit(value)))
    return F.coalesce(test, F.lit(False))


def _selector_key(sel: Column) -> Column:
    """The most selective part of a compiled selector: its id, else its first class, attribute or tag."""
    return (F.when(sel["id"] != "", F.concat(F.lit("#"), sel["id"]))
            .when(F.size(sel["classes"]) > 0, F.concat(F.lit("."), sel["classes"][0]))
            .when(F.size(sel["attr_keys"]) > 0, F.concat(F.lit("["), sel["attr_keys"][0])).otherwise(sel["tag"]))


def _node_keys() -> Column:
    """All keys by which selectors can ask for a node."""
    classes = F.transform(F.array_distinct(T.words(F.coalesce("class", F.lit("")))), lambda c: F.concat(F.lit("."), c))
    names = F.transform(F.coalesce(F.map_keys("attributes"), F.array().cast("array<string>")), lambda k: F.concat(F.lit("["), k))
    own = F.when(F.coalesce("id", F.lit("")) != "", F.array(F.concat(F.lit("#"), F.col("id")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lower("tag")), own, classes, names)


def match_nodes(selectors: DataFrame, nodes: DataFrame, sel_col: str = "selector") -> DataFrame:
    """Every (selector row, node) pair on the same page that matches.

    ``selectors`` needs ``page_id`` and ``sel_col``; ``nodes`` is the element table.
    A selector asks by its most selective part and a node answers to each of its
    own, so a selector meets only nodes that have its id, class, attribute or tag.
    """
    s = selectors.withColumn("_sel", compile_selector(sel_col))
    s = s.withColumn("_key", _selector_key(F.col("_sel")))
    pages = s.select("page_id").distinct()
    el = nodes.filter(F.col("tag") != "#text").join(pages, "page_id", "left_semi").withColumn("_key", F.explode(_node_keys()))
    return s.join(el, ["page_id", "_key"]).filter(matches(F.col("_sel"))).drop("_sel", "_key")


def first_match(selector_lists: DataFrame, nodes: DataFrame, key: str = "row_id",
                list_col: str = "css_selector_list") -> DataFrame:
    """For each row, the lowest list position whose selector matches, and in it
    the first node in document order.  Returns ``key, page_id, matched_selector,
    matched_pos`` and the node's columns."""
    ex = selector_lists.select(key, "page_id", F.posexplode(list_col).alias("sel_pos", "selector"))
    m = match_nodes(ex, nodes, "selector")
    best = m.groupBy(key).agg(F.min_by(F.struct(*[c for c in m.columns if c != key]),
                                       F.struct("sel_pos", "node_id")).alias("_m"))
    return best.select(key, "_m.*")


def move_to_front(lst, item) -> Column:
    """Remove the first occurrence of ``item`` and put it at position 0."""
    arr, it = _c(lst), _c(item)
    pos = F.array_position(arr, it)   # 1-based, 0 when absent
    before = F.slice(arr, 1, F.greatest(pos - 1, F.lit(0)))
    after = F.when(pos > 0, F.slice(arr, pos + 1, F.greatest(F.size(arr) - pos, F.lit(0)))) \
             .otherwise(arr)
    return F.when(pos > 0, F.concat(F.array(it), before, after)).otherwise(F.concat(F.array(it), arr))


def legacy_selector(tag="tag", id_="id", attributes="attributes") -> Column:
    """``tag#id[k='v']...`` from the given criteria, ``body`` when none."""
    t, i = F.coalesce(_c(tag), F.lit("")), F.coalesce(_c(id_), F.lit(""))
    attrs = F.coalesce(_c(attributes), F.create_map().cast("map<string,string>"))
    parts = F.array_join(F.transform(F.map_entries(attrs),
                                     lambda e: F.concat(F.lit("["), e["key"], F.lit("='"), e["value"], F.lit("']"))), "")
    sel = F.concat(t, F.when(i != "", F.concat(F.lit("#"), i)).otherwise(F.lit("")), parts)
    return F.when(sel == "", F.lit("body")).otherwise(sel)
