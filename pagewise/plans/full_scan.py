"""C1/C2 full scan: find each page's main-content element and its selectors.

Steps per page, all as DataFrame joins and aggregations over ``dom_nodes``:

1. T1 candidates: every element scored against the page box; the best valid
   one (ties in breadth-first order) starts the refinement.
2. C1 refinement (at most 5 passes; 10 in the legacy profile): the current
   root's subtree is joined by its interval, every node is rescored against the
   root's box with a depth weight, and the root moves to the best node while
   that node scores strictly higher.  Only pages that still move take part in
   a pass.
3. T8 selector list from the last rescoring (ranks 2-4, nodes repeated as the
   reference's list repeats them), own selector first.
4. A10/A11 links and text of the winner; P16/P17 page type; J5 pagination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dom_scores as DS
from ..operators import dom as DOM
from ..operators import pagination as PG
from ..session import cut_lineage, one_table, stored_by

NODE_COLS = ["node_id", "subtree_end", "depth", "tag", "id", "attributes", "css_selector", "rect", "n_links",
             "text_len", "n_words"]


def prepare(pages: DataFrame, nodes: DataFrame | None = None, cut: bool = True):
    """``(nodes, prepared)`` for ``pages(page_id, url, html)``: the raw node table
    (parsed when not given) and the scoring-ready element table.  Both are written
    once, bucketed by page and sorted: whatever goes page by page afterwards
    (windows, refinement passes, subtree contents) reads them as they lie."""
    if nodes is None:
        from ..sources.html_nodes import html_to_nodes
        nodes = html_to_nodes(pages)
    if cut:
        nodes = stored_by(nodes, "page_id", ["page_id", "node_id"], "nodes")
    prepared = DOM.prepared_nodes(nodes, pages)
    return nodes, (stored_by(prepared, "page_id", ["page_id", "node_id"], "elements") if cut else prepared)


def candidates(prepared: DataFrame, profile: DS.Profile = DS.CURRENT) -> DataFrame:
    """All valid elements with their candidacy score (every element is scored;
    only valid ones are candidates)."""
    score = DS.candidacy_score(profile=profile)
    return (prepared.withColumn("cand_score", score)
                    .filter(DS.is_valid_element("tag", "rect", profile)))


def top_candidate(cands: DataFrame) -> DataFrame:
    """Best candidate per page; ties keep breadth-first order (depth, then document order)."""
    best = cands.groupBy("page_id").agg(
        F.max_by(F.struct(*NODE_COLS, "cand_score"),
                 F.struct(F.col("cand_score"), -F.col("depth"), -F.col("node_id"))).alias("b"))
    return best.select("page_id", "b.*")


def _rescore(prepared: DataFrame, roots: DataFrame, profile: DS.Profile) -> DataFrame:
    """Rescore every node of each root's subtree against the root's box."""
    r = roots.select("page_id", F.col("root_id"), F.col("root_end"), F.col("root_rect"), F.col("root_depth"))
    sub = DOM.in_subtree(prepared.select("page_id", *NODE_COLS), r.hint("merge"))
    score = DS.refinement_score(F.col("rect"), F.col("root_rect.width"), F.col("root_rect.height"),
                                F.col("depth"), F.col("root_depth"), F.col("n_links"), F.col("text_len"), profile)
    return sub.withColumn("score", score)


def refine(prepared: DataFrame, start: DataFrame, profile: DS.Profile = DS.CURRENT,
           checkpoint: bool = True) -> DataFrame:
    """Refinement, pass by pass.  ``start`` = top candidates.

    A pass joins only the pages that still move to the nodes of their current
    root's interval (by page, so a bucketed ``prepared`` stays where it is) and
    aggregates per page.  Pages whose root no node beats leave the loop with their
    state; it ends when no page is left or after the last pass.  ``checkpoint``
    (default) cuts the one-row-per-page state of every pass, which keeps each pass
    a short job and bounds recomputation after an executor loss.

    Output per page: the final root (``root_*``), its ``score``, ``moves`` and the
    root whose rescoring gave the final list (``list_*``) for T8.
    """
    moving = start.select(
        "page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"),
        F.col("rect").alias("root_rect"), F.col("depth").alias("root_depth"),
        F.col("cand_score").alias("score"), F.lit(0).alias("moves"))
    state_cols = moving.columns
    root = ["root_id", "root_end", "root_rect", "root_depth"]
    nodes = prepared.select(F.col("page_id").alias("_p"), *NODE_COLS)
    always_first = profile.name == "legacy"
    passes = profile.max_moves + (1 if always_first else 0)
    finished = None
    for i in range(passes):
        s = moving.hint("merge").alias("s")        # a broadcast would pass the state through the driver, pass by pass
        cond = ((F.col("_p") == F.col("s.page_id")) & (F.col("node_id") >= F.col("s.root_id"))
                & (F.col("node_id") <= F.col("s.root_end")))
        score = DS.refinement_score(F.col("rect"), F.col("s.root_rect.width"), F.col("s.root_rect.height"),
                                    F.col("depth"), F.col("s.root_depth"), F.col("n_links"), F.col("text_len"),
                                    profile)
        met = s.join(nodes, cond).withColumn("_score", score)
        best = met.groupBy(F.col("s.page_id").alias("page_id")).agg(
            F.first(F.struct(*[F.col("s." + c).alias(c) for c in state_cols[1:]])).alias("st"),
            F.max_by(F.struct(F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"), F.col("rect").alias("root_rect"),
                              F.col("depth").alias("root_depth"), F.col("_score").alias("score")),
                     F.struct(F.col("_score"), -F.col("node_id"))).alias("best"),
            F.max(F.when(F.col("node_id") == F.col("s.root_id"), F.col("_score"))).alias("root_score"))
        moves = F.lit(True) if always_first and i == 0 else F.col("best.score") > F.col("root_score")
        best = best.withColumn("_moves", F.coalesce(moves, F.lit(False)))
        listed = [F.col("st." + c).alias(c.replace("root_", "list_")) for c in root]
        state = best.select(
            "page_id", *[F.when(F.col("_moves"), F.col("best." + c)).otherwise(F.col("st." + c)).alias(c) for c in root],
            F.when(F.col("_moves"), F.col("best.score")).otherwise(F.coalesce("root_score", "st.score")).alias("score"),
            (F.col("st.moves") + F.col("_moves").cast("int")).alias("moves"), (~F.col("_moves")).alias("done"), *listed)
        if checkpoint:
            state = cut_lineage(state)
        last = i == passes - 1
        left = state if last else state.where("done")
        finished = left if finished is None else finished.unionByName(left)
        moving = state.where("not done").select(*state_cols)
        if checkpoint and moving.isEmpty():
            break
    # readers plan one table, not every pass's
    return cut_lineage(one_table(finished)) if checkpoint and i else finished


def selector_list(prepared: DataFrame, state: DataFrame, profile: DS.Profile = DS.CURRENT,
                  n_extra: int = 3) -> DataFrame:
    """Selectors at ranks 2..(1+n_extra) of the last rescoring, own selector first.

    The current scorer's list repeats a node at relative depth d (d+1) times;
    copies tie on score and are ordered by generation, then document order.
    Only the first ``n_extra + 1`` list positions are needed, so at most that
    many copies of a node can matter: the expansion is capped there, exactly.
    """
    roots = state.select("page_id", F.col("list_id").alias("root_id"), F.col("list_end").alias("root_end"),
                         F.col("list_rect").alias("root_rect"), F.col("list_depth").alias("root_depth"))
    scored = _rescore(prepared, roots, profile)
    if profile.repeat_rescored:
        copies = F.least(F.col("depth") - F.col("root_depth"), F.lit(n_extra)) + 1
        scored = scored.withColumn("gen", F.explode(F.sequence(F.lit(0), copies - 1)))
    else:
        scored = scored.withColumn("gen", F.lit(0))
    from ..operators.rank import top_n_per_group
    top = top_n_per_group(scored, ["page_id"], [F.col("score").desc(), F.col("gen").asc(), F.col("node_id").asc()],
                          n_extra + 1, rank_col="pos")
    picked = (top.filter((F.col("pos") >= 1) & (F.col("css_selector") != ""))
                 .groupBy("page_id")
                 .agg(F.array_sort(F.collect_list(F.struct("pos", "css_selector"))).alias("_s"))
                 .select("page_id", F.transform("_s", lambda s: s["css_selector"]).alias("_extra")))
    return picked


def main_content(pages: DataFrame, prepared: DataFrame, nodes: DataFrame | None = None,
                 profile: DS.Profile = DS.CURRENT, previous_type: str | None = None,
                 checkpoint: bool = True) -> DataFrame:
    """C2 without pagination: one row per page that has a main-content element."""
    start = top_candidate(candidates(prepared, profile))
    state = refine(prepared, start, profile, checkpoint)
    own = prepared.select("page_id", "node_id", "tag", "id", "attributes", "css_selector", "n_links", "text_len", "n_words")
    final = DOM.in_subtree(own, state.withColumn("_same", F.col("root_id")).hint("merge"), "root_id", "_same").drop("_same", "node_id")
    if profile.name == "current":
        sels = selector_list(prepared, state, profile)
        final = final.join(sels, "page_id", "left")
        own = F.col("css_selector")
        extra = F.coalesce(F.col("_extra"), F.array().cast("array<string>"))
        final = final.withColumn(
            "css_selector_list",
            F.when((own != "") & ~F.array_contains(extra, own), F.concat(F.array(own), extra)).otherwise(extra)
        ).drop("_extra")
    else:
        final = final.withColumn("css_selector_list", F.array("css_selector"))
    final = final.join(pages.select("page_id", "url"), "page_id")
    wt = PG.web_type("url")
    final = final.withColumn("web_type", PG.merge_web_type(wt, F.lit(previous_type)) if previous_type else wt)
    if nodes is not None:
        if checkpoint:          # its roots are read for the text, the links and the result
            final = cut_lineage(final)
        roots = final.select("page_id", "root_id", "root_end").hint("merge")
        final = (final.join(DOM.subtree_text(nodes, roots), ["page_id", "root_id"], "left")
                      .join(DOM.subtree_links(nodes, roots, pages), ["page_id", "root_id"], "left")
                      .withColumn("text", F.coalesce("text", F.lit(""))))
    return (final.withColumnRenamed("root_id", "node_id").withColumnRenamed("root_rect", "rect")
                 .withColumnRenamed("root_depth", "depth").withColumnRenamed("root_end", "subtree_end"))
