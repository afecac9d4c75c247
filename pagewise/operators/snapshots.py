"""The nested record of a subtree as one JSON document, and back to node rows.

A subtree's document is put together without recursion: each node gives a piece that opens its record, at its own
place in document order, and one that closes it, behind its last descendant.  One aggregate per root joins the pieces
in that order; a root's pieces come from one page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom as DOM

RECT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "width", "height")])
# The fields of a record in their order, with their types; children and result_items are records.
FIELDS = {
    "tag": T.StringType(), "id": T.StringType(), "attributes": T.MapType(T.StringType(), T.StringType()), "children": None, "rect": RECT,
    "depth": T.IntegerType(), "text": T.StringType(), "score": T.DoubleType(), "css_selector": T.StringType(),
    "css_selector_list": T.ArrayType(T.StringType()), "links": T.ArrayType(T.StringType()), "chk_url": T.StringType(), "web_type": T.StringType(),
    "result_count": T.IntegerType(), "result_items": None, "relevance_score": T.DoubleType(), "avg_relevance": T.DoubleType(),
    "relevance_variance": T.DoubleType(), "max_relevance": T.DoubleType(), "sqs_score": T.DoubleType(), "quality_category": T.StringType(),
    "is_empty_result": T.BooleanType(),
}
_BEFORE = ("tag", "id", "attributes")
_BETWEEN = tuple(list(FIELDS)[4:14])
_AFTER = tuple(list(FIELDS)[15:])
_EMPTY = {T.StringType(): "''", T.IntegerType(): "0", T.DoubleType(): "0D", T.BooleanType(): "false", RECT: "named_struct('x', 0D, 'y', 0D, 'width', 0D, 'height', 0D)",
          T.ArrayType(T.StringType()): "cast(array() as array<string>)", T.MapType(T.StringType(), T.StringType()): "cast(map() as map<string, string>)"}


def _value(name: str, columns: list[str]) -> Column:
    kind = FIELDS[name]
    empty = F.expr(_EMPTY[kind])
    return F.coalesce(F.col(name).cast(kind), empty).alias(name) if name in columns else empty.alias(name)


def _inside(names: tuple[str, ...], columns: list[str]) -> Column:
    """The fields as the inside of a JSON record."""
    record = F.to_json(F.struct(*(_value(n, columns) for n in names)))
    return F.substring(record, F.lit(2), F.length(record) - 2)


def documents(nodes: DataFrame, prepared: DataFrame, roots: DataFrame, pages: DataFrame, values: DataFrame | None = None,
              items: DataFrame | None = None) -> DataFrame:
    """``page_id, root_id, json`` for ``roots(page_id, root_id, root_end)``.

    ``nodes`` has the text runs and links, ``prepared`` the elements.  ``values(page_id, node_id, ...)`` brings those of the
    other fields that are known of a node (scores, selectors, quality); without a value a field is empty.  ``items``
    (same columns as ``roots``, with ``of_root``, the root they belong to) are the result items of a root: each is a
    record in its ``result_items``, in document order."""
    el = DOM.in_subtree(prepared, roots)
    every = el.select("page_id", F.col("node_id").alias("own_id"), F.col("subtree_end").alias("own_end")).distinct()
    text = DOM.subtree_text(nodes, every, "own_id", "own_end").withColumnRenamed("own_id", "node_id")
    links = DOM.subtree_links(nodes, every, pages, "own_id", "own_end").withColumnRenamed("own_id", "node_id")
    el = el.drop("text", "links").join(text, ["page_id", "node_id"], "left").join(links, ["page_id", "node_id"], "left")
    if values is not None:
        new = [c for c in values.columns if c not in ("page_id", "node_id")]
        el = el.drop(*new).join(values, ["page_id", "node_id"], "left")
    if items is not None:
        inner = documents(nodes, prepared, items.drop("of_root"), pages, values)
        held = (inner.join(items.select("page_id", "root_id", "of_root"), ["page_id", "root_id"])
                .groupBy("page_id", F.col("of_root").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("root_id", "json"))).alias("_held")))
        el = el.join(held, ["page_id", "node_id"], "left")
        result_items = F.coalesce(F.array_join(F.transform("_held", lambda h: h["json"]), ","), F.lit(""))
    else:
        result_items = F.lit("")
    columns = el.columns
    is_root = F.col("node_id") == F.col("root_id")
    opening = F.concat(F.lit("{"), _inside(_BEFORE, columns), F.lit(',"children":['))
    closing = F.concat(F.lit("],"), _inside(_BETWEEN, columns), F.lit(',"result_items":['), F.when(is_root, result_items).otherwise(F.lit("")),
                       F.lit("],"), _inside(_AFTER, columns), F.lit("}"))
    first_child = F.col("parent_id").isNotNull() & (F.col("node_id") == F.col("_first"))
    firsts = prepared.where("parent_id is not null").groupBy("page_id", F.col("parent_id")).agg(F.min("node_id").alias("_first"))
    el = el.join(firsts, ["page_id", "parent_id"], "left")
    comma = F.when(is_root | F.coalesce(first_child, F.lit(True)), F.lit("")).otherwise(F.lit(","))
    # a record closes after the last of its descendants; of those that close there, the deepest first
    pieces = el.select("page_id", "root_id", F.explode(F.array(
        F.struct(F.col("node_id").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("up"), F.concat(comma, opening).alias("piece")),
        F.struct(F.col("subtree_end").alias("at"), F.lit(1).alias("side"), (-F.col("node_id")).alias("up"), closing.alias("piece")))).alias("p"))
    return (pieces.groupBy("page_id", "root_id").agg(F.array_sort(F.collect_list("p")).alias("_p"))
            .select("page_id", "root_id", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("json")))


NODE_ROWS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()),
    T.StructField("subtree_size", T.IntegerType()), *(T.StructField(n, k or T.StringType()) for n, k in FIELDS.items() if n != "children")])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = NODE_ROWS.names[4:]
    for pdf in batches:
        out = []
        for page, text in zip(pdf["page_id"].tolist(), pdf["json"].tolist()):
            start, stack = len(out), [(json.loads(text) if text else None, None)]
            while stack:
                node, parent = stack.pop()
                if not node:
                    continue
                at = len(out) - start
                own = {n: node.get(n) for n in names}
                own["result_items"] = json.dumps(own["result_items"] or [], ensure_ascii=False)
                rect = own["rect"] or None
                own["rect"] = rect and {n: float(rect.get(n) or 0) for n in RECT.names}
                out.append([page, at, parent, 1, *own.values()])
                stack.extend((c, at) for c in reversed(node.get("children") or []))
            for i in range(len(out) - 1, start, -1):            # a node's size is known before its parent's
                if out[i][2] is not None:
                    out[start + out[i][2]][3] += out[i][3]
        yield pd.DataFrame(out, columns=NODE_ROWS.names).astype({"parent_id": "Int32", "depth": "Int32", "result_count": "Int32"})


def read_documents(docs: DataFrame, page_id: str = "page_id", doc: str = "json") -> DataFrame:
    """Nested documents -> node rows in document order, all fields of a record; ``result_items`` stays JSON."""
    from ..session import ship_package
    ship_package(docs.sparkSession)
    return docs.select(F.col(page_id).cast("long").alias("page_id"), F.col(doc).alias("json")).mapInPandas(_rows, NODE_ROWS)
