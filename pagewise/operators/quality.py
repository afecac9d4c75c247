"""Search-results-page quality.

All steps are joins/aggregations on the element table restricted to each
page's main-content subtree (one interval per page).
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dom as DOM
from . import selectors as SEL

# The no-results rules (keywords, selectors that mean "no results",
# selectors of an expected results container).
NO_RESULTS_KEYWORDS = [
    "検索結果がありません", "該当する情報は見つかりませんでした", "no results found",
    "nothing found", "we couldn't find anything", "お探しのページは見つかりませんでした",
    "ページが見つかりません", "404 not found",
]
NO_RESULTS_SELECTORS = [".no-results", "#no-results-message", "[data-qa='no-results-found']", ".empty-state"]
EXPECTED_RESULTS_SELECTORS = [".search-results", ".results-list", "#search-results-container"]
MIN_ITEM_WORDS = 10


@dataclass(frozen=True)
class Rules:
    """The rule table of a run; a caller may bring other words, selectors and limits."""
    none_keywords: tuple[str, ...] = tuple(NO_RESULTS_KEYWORDS)
    none_selectors: tuple[str, ...] = tuple(NO_RESULTS_SELECTORS)
    some_selectors: tuple[str, ...] = tuple(EXPECTED_RESULTS_SELECTORS)
    min_item_words: int = MIN_ITEM_WORDS


RULES = Rules()


def valid_result_item(n_links="n_links", n_words="n_words", rules: Rules = RULES) -> Column:
    """at least one link and at least 10 whitespace words."""
    return (F.coalesce(F.col(n_links), F.lit(0)) > 0) & (F.coalesce(F.col(n_words), F.lit(0)) >= rules.min_item_words)


def has_keyword(text, keywords=RULES.none_keywords) -> Column:
    t = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return reduce(operator.or_, (F.contains(t, F.lit(k.lower())) for k in keywords), F.lit(False))


def no_results(main: DataFrame, prepared: DataFrame, pages: DataFrame, default_empty: bool = True,
               rules: Rules = RULES) -> DataFrame:
    """F4 per page: keyword in the main text -> true; a no-results selector anywhere
    on the page -> true; an expected results container -> false; else ``default_empty``.

    The selectors are constants, so one pass over the elements tells for each page
    whether any of them matches."""
    def some(selectors):
        return F.bool_or(reduce(operator.or_, (SEL.constant_selector(s) for s in selectors), F.lit(False)))
    seen = prepared.groupBy("page_id").agg(some(rules.none_selectors).alias("_nr"), some(rules.some_selectors).alias("_ex"))
    j = main.select("page_id", "text").join(pages.select("page_id"), "page_id", "left_semi").join(seen, "page_id", "left")
    res = (F.when(has_keyword("text", rules.none_keywords), True).when(F.col("_nr"), True).when(F.col("_ex"), False)
           .otherwise(F.lit(default_empty)))
    return j.select("page_id", res.alias("is_no_results"))


def result_container(prepared: DataFrame, main: DataFrame) -> DataFrame:
    """A3 + A4: inside each main subtree (itself included) the element whose children
    repeat one exact ``class`` value most: score = count^2 / children, needs >= 2
    children and count > 1; the first in document order wins ties."""
    roots = main.select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
    scope = DOM.in_subtree(prepared.select("page_id", "node_id"), roots).select("page_id", "node_id")
    kids = (prepared.filter(F.col("parent_id").isNotNull())
                    .select("page_id", F.col("parent_id").alias("node_id"),
                            F.coalesce(F.try_element_at("attributes", F.lit("class")), F.lit("")).alias("cls")))
    kids = kids.join(scope, ["page_id", "node_id"], "left_semi")
    n_children = kids.groupBy("page_id", "node_id").agg(F.count(F.lit(1)).alias("n_children"))
    reps = (kids.filter(F.col("cls") != "").groupBy("page_id", "node_id", "cls").agg(F.count(F.lit(1)).alias("cnt"))
                .groupBy("page_id", "node_id").agg(F.max("cnt").alias("rep")))
    scored = (n_children.join(reps, ["page_id", "node_id"])
                        .filter((F.col("n_children") >= 2) & (F.col("rep") > 1))
                        .withColumn("container_score", F.col("rep") * F.col("rep") / F.col("n_children")))
    best = scored.groupBy("page_id").agg(
        F.max_by(F.struct("node_id", "container_score", "n_children"),
                 F.struct(F.col("container_score"), -F.col("node_id"))).alias("c"))
    return best.select("page_id", F.col("c.node_id").alias("container_id"),
                       F.col("c.container_score").alias("container_score"), F.col("c.n_children").alias("n_children"))


def result_items(prepared: DataFrame, containers: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A5 rows: the container's children that are valid result items."""
    kids = prepared.join(containers.select("page_id", F.col("container_id").alias("parent_id")),
                         ["page_id", "parent_id"])
    return kids.filter(valid_result_item(rules=rules))


def quantify(items: DataFrame, main: DataFrame) -> DataFrame:
    """A5/A13 per page: ``result_count`` and the ordered item ids (0 and [] without a container)."""
    agg = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("result_count"),
                                       F.sort_array(F.collect_list("node_id")).alias("result_item_ids"))
    return (main.select("page_id").join(agg, "page_id", "left")
                .withColumn("result_count", F.coalesce("result_count", F.lit(0)))
                .withColumn("result_item_ids", F.coalesce("result_item_ids", F.array().cast("array<int>"))))
