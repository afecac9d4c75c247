"""C6 page quality, C7 search-and-validate, C8 item relevance on results pages,
C10 content processing.

Per page: main content (C2) -> no-results triage (F4) -> result container and
valid items (A3-A5) -> relevance of each item's text to the page's query (C8)
-> mean / population variance / max (A6) -> SQS and category (P15).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as TX
from ..functions import urls as U
from ..operators import dom as DOM
from ..operators import quality as Q
from ..operators import relevance as R
from ..session import written
from . import full_scan as FS

# Labels of the validation report.
LABELS = {"empty": "EMPTY", "low": "LOW QUALITY", "invalid": "INVALID", "none": "no content", "valid": "VALID"}


def evaluate(pages: DataFrame, queries: DataFrame, nodes: DataFrame, prepared: DataFrame,
             main: DataFrame | None = None, semantic: DataFrame | None = None, rules: Q.Rules = Q.RULES,
             model: Callable | None = None) -> DataFrame:
    """C6 for every page with a main content.  ``queries(page_id, query)``; ``rules`` override the rule table (S7),
    ``model`` or ``semantic`` bring the semantic score of the items."""
    if main is None:
        main = FS.main_content(pages, prepared, nodes)
    # read for the triage, the container, the counts and the result
    main = written(main.select("page_id", "node_id", "subtree_end", "tag", "css_selector", "text", "url"), "quality-main")
    nr = Q.no_results(main, prepared, pages, rules=rules)
    cont = Q.result_container(prepared, main)
    cont = written(cont, "quality-containers")
    items = written(Q.result_items(prepared, cont, rules).select("page_id", "node_id", "subtree_end"), "quality-items")
    counts = Q.quantify(items, main)
    # texts of the valid items (disjoint subtrees -> one interval each)
    roots = items.select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
    item_text = DOM.subtree_text(nodes, roots).withColumnRenamed("root_id", "node_id")
    scored = R.score_relevance(item_text.select("page_id", "node_id", "text"), queries, "page_id", "node_id",
                               "text", semantic=semantic, model=model, whole_groups=True)      # a page's items
    stats = scored.groupBy("page_id").agg(F.avg("relevance_score").alias("avg_relevance"),
                                          F.var_pop("relevance_score").alias("relevance_variance"),
                                          F.max("relevance_score").alias("max_relevance"))
    out = (main.select("page_id", "node_id", "tag", "css_selector", "text", "url")
               .join(nr, "page_id", "left").join(cont, "page_id", "left").join(counts, "page_id", "left")
               .join(stats, "page_id", "left"))
    empty = F.col("is_no_results") | (F.col("result_count") == 0)
    scored_ok = ~empty & F.col("avg_relevance").isNotNull()
    sqs = S.sqs("result_count", "avg_relevance", "relevance_variance", "max_relevance")
    return (out.withColumn("is_empty_result", empty)
               .withColumn("sqs_score", F.when(scored_ok, sqs))
               .withColumn("quality_category", F.when(scored_ok, S.sqs_category("result_count", sqs))))


def validate(evaluated: DataFrame, keyword_col: str = "query") -> DataFrame:
    """C7/F8 labels and P10 snippet: VALID needs a non-empty text, category Valid and
    the keyword in the text (case-insensitive)."""
    txt = F.coalesce(F.col("text"), F.lit(""))
    label = (F.when(F.col("node_id").isNull(), LABELS["none"])
             .when(F.col("is_empty_result"), LABELS["empty"])
             .when(txt == "", LABELS["none"])
             .when(F.col("quality_category") == "Low Quality", LABELS["low"])
             .when((F.col("quality_category") == "Valid")
                   & (F.instr(F.lower(txt), F.lower(F.col(keyword_col))) > 0), LABELS["valid"])
             .otherwise(LABELS["invalid"]))
    return evaluated.withColumn("label", label).withColumn("snippet", TX.snippet("text")) \
                    .withColumn("title", F.col("tag"))


def result_urls(nodes: DataFrame, pages: DataFrame, block_class: str = "g", limit: int = 5) -> DataFrame:
    """S9 + A1 + T7: http(s) links inside result blocks (``div.<block_class>``) of a
    results page, first occurrence order, first ``limit`` per page."""
    blocks = (nodes.filter((F.col("tag") == "div")
                           & F.array_contains(TX.words(F.coalesce("class", F.lit(""))), block_class))
                   .select("page_id", F.col("node_id").alias("root_id"),
                           (F.col("node_id") + F.col("subtree_size") - 1).alias("root_end")))
    a = nodes.filter((F.col("tag") == "a") & F.col("href").startswith("http")).select("page_id", "node_id", "href")
    inside = DOM.in_subtree(a, blocks)
    first = inside.groupBy("page_id", "href").agg(F.min("node_id").alias("pos"))
    from ..operators.rank import top_n_per_group
    return top_n_per_group(first, ["page_id"], [F.col("pos").asc()], limit, rank_col="rank")


#: What holds no tags of the page itself; a tag with its attributes; an attribute of it, with either quotes or none.
_NO_TAGS = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_META_TAG = r"(?is)<meta\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
_ATTRIBUTE = r"(?is)\s{}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    value = F.concat(*(F.regexp_extract(tag, _ATTRIBUTE.format(name), i) for i in (1, 2, 3)))
    for entity, char in _ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def meta_content(html, attribute: str, value: str) -> Column:
    """The content of the page's first ``meta`` tag whose ``attribute`` is ``value``, whatever the order and quotes of
    its attributes; null without such a tag, or where its content is empty."""
    bare = F.regexp_replace(F.col(html) if isinstance(html, str) else html, _NO_TAGS, "")
    first = F.get(F.filter(F.regexp_extract_all(bare, F.lit(_META_TAG), F.lit(0)), lambda t: _attribute(t, attribute) == value), F.lit(0))
    return F.nullif(_attribute(first, "content"), F.lit(""))


AUTHOR, PUBLISHED = ("name", "author"), ("property", "article:published_time")


def process_content(pages: DataFrame, main: DataFrame, extracted: DataFrame | None = None) -> DataFrame:
    """C10 + P24 + P14: main text, author, date, credibility.  ``extracted(page_id, author, date, sitename)`` is what an
    extractor found; what it left empty falls back to the page's ``meta`` tags (the site name to the host)."""
    p = pages.select("page_id", "url", meta_content("html", *AUTHOR).alias("_author"),
                     meta_content("html", *PUBLISHED).alias("_date"), U.netloc("url").alias("_sitename"))
    names = ("author", "date", "sitename")
    if extracted is not None:
        p = p.join(extracted.select("page_id", *names), "page_id", "left")
    else:
        p = p.select("*", *[F.lit(None).cast("string").alias(c) for c in names])
    p = p.select("page_id", "url", *[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col("_" + c)).alias(c) for c in names])
    out = p.join(main.select("page_id", "text"), "page_id", "left")
    return out.withColumn("final_url", F.col("url")).withColumn(
        "credibility_score", S.credibility("final_url", "author", "date"))


def search_and_validate(results_pages: DataFrame, result_nodes: DataFrame, pages: DataFrame,
                        keyword: str, limit: int = 5) -> DataFrame:
    """Result URLs of each search-results page (S9, first ``limit``, T7), each
    target page evaluated (C6) against the keyword and labelled (F8, P10).

    ``results_pages(page_id, url)`` with their parsed ``result_nodes``; ``pages``
    holds the snapshots of the target URLs (``page_id, url, html``).
    """
    urls = result_urls(result_nodes, results_pages, limit=limit).select(
        F.col("page_id").alias("results_page_id"), F.col("rank"), F.col("href").alias("url"))
    targets = pages.join(urls.select("url").distinct(), "url", "left_semi")
    nodes, prep = FS.prepare(targets)
    q = targets.select("page_id").withColumn("query", F.lit(keyword))
    ev = evaluate(targets, q, nodes, prep).join(q, "page_id")
    labelled = validate(ev)
    out = urls.join(labelled.drop("page_id"), "url", "left")
    return out.withColumn("label", F.coalesce("label", F.lit(LABELS["none"])))
