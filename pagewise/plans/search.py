"""C9 high-precision search as DataFrame jobs over stored result lists.

Input ``hits(corpus, seq, doc, href, title, body)``: the deduplicated results of each result list (``corpus``), ``seq``
their original order.  ``queries(search, corpus, query)``: any number of searches, each over one list.

Plan: J7 enrich -> written index -> BM25 top-n (A8a, T3) -> model re-rank of those (T4,
identity without a model) -> credibility rank of each list (T5) -> RRF (A7) -> final top-n (T6).  Rankings have a total
order (score descending, ``seq`` ascending), scores compared at 1e-9 so that float summation order cannot flip ties.

A search never meets all hits of its list: a document that is neither in its lexical list nor among the first of the
list by credibility can't be in its final list, so only those are fused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import inverted as I
from ..operators import relevance as R
from ..operators import search as H
from ..operators.rank import blocked_rank, positions, top_n_per_group
from ..session import written

SCORE_DIGITS = I.SCORE_DIGITS


def enriched(hits: DataFrame, content: DataFrame | None = None) -> DataFrame:
    """J7 + P14: hits with their content's text and credibility (0.0 without)."""
    docs = H.enrich_hits(hits, content) if content is not None else hits
    if "credibility_score" not in docs.columns:
        docs = docs.withColumn("credibility_score", F.lit(0.0))
    return docs.withColumn("credibility_score", F.coalesce("credibility_score", F.lit(0.0)))


def ranked_search(index: I.TextIndex, docs: DataFrame, queries: DataFrame, model: Callable | None = None,
                  semantic: DataFrame | None = None, lexical_top_n: int = 100, semantic_top_n: int = 25,
                  rrf_k: int = H.RRF_K) -> DataFrame:
    """T3-T6 for every row of ``queries``: ``search, corpus, doc, final_rank, final_score, bm25_score,
    credibility_score`` and ``docs``' other columns for the first ``semantic_top_n`` documents.

    T4 takes the lexical list: ``model`` (see :func:`relevance.model_score`) scores its texts, or ``semantic(search, doc,
    semantic_score)`` brings scores; without either the list stays as it is."""
    lexical = written(I.bm25_top(index, queries, lexical_top_n), "search-lexical")
    scored = None
    if model is not None:
        texts = lexical.join(docs.select("corpus", "doc", "body"), ["corpus", "doc"]).join(queries.select("search", "query"), "search")
        score = R.model_score(model)(F.coalesce("query", F.lit("")), F.coalesce("body", F.lit("")))
        scored = texts.select("search", "doc", "rank", score.alias("semantic_score"))
    elif semantic is not None:
        scored = (lexical.select("search", "doc", "rank").join(semantic.select("search", "doc", "semantic_score"), ["search", "doc"], "left")
                  .fillna(0.0, ["semantic_score"]))
    reranked = lexical
    if scored is not None:
        scored = scored.withColumn("semantic_score", F.round("semantic_score", SCORE_DIGITS)).withColumnRenamed("rank", "lexical_rank")
        reranked = written(R.semantic_rerank(scored, "search", "lexical_rank", "semantic_score", semantic_top_n), "search-semantic")

    listed = written(blocked_rank(docs.select("corpus", "doc", "seq", "credibility_score"), ["corpus"], "credibility_score", "seq"),
                     "search-credibility")
    near = lexical_top_n + semantic_top_n
    heads = listed.where(F.col("rank") < near).join(queries.select("search", "corpus"), "corpus").select("search", "doc", "rank")
    own = lexical.select("search", "corpus", "doc").join(listed.where(F.col("rank") >= near), ["corpus", "doc"]).select("search", "doc", "rank")
    fused = H.rrf([lexical, reranked, heads.unionByName(own)], ["search", "doc"], k=rrf_k)
    fused = (fused.join(queries.select("search", "corpus"), "search")
             .join(listed.select("corpus", "doc", "seq", "credibility_score"), ["corpus", "doc"]))
    final = top_n_per_group(fused.withColumnRenamed("rrf_score", "final_score"), ["search"],
                            [F.round("final_score", SCORE_DIGITS).desc(), F.col("seq").asc()], semantic_top_n, rank_col="final_rank")
    final = written(final, "search-final")
    final = (final.join(I.bm25_of(index, queries, final.select("search", "corpus", "doc")), ["search", "doc"], "left")
             .fillna(0.0, ["bm25_score"]))
    if scored is not None:
        final = final.join(reranked.select("search", "doc", "semantic_score"), ["search", "doc"], "left")
    # the payload (title, body, ...) is joined to the top rows only
    return final.join(docs.drop("seq", "credibility_score"), ["corpus", "doc"], "left")


def high_precision_search(hits: DataFrame, queries: DataFrame, content: DataFrame | None = None,
                          semantic: DataFrame | None = None, lexical_top_n: int = 100,
                          semantic_top_n: int = 25, rrf_k: int = H.RRF_K,
                          group: str = "search_id", key: str = "doc_key", model: Callable | None = None) -> DataFrame:
    """C9 where each search has a result list of its own: ``hits(search_id, doc_key, seq, ...)``,
    ``queries(search_id, query)``."""
    docs = written(enriched(hits, content).withColumnRenamed(group, "corpus").withColumnRenamed(key, "doc"), "search-docs")
    index = I.build_index(docs, "corpus", "doc", "body", "seq")
    asked = queries.select(F.col(group).alias("search"), F.col(group).alias("corpus"), "query")
    if semantic is not None:
        semantic = semantic.select(F.col(group).alias("search"), F.col(key).alias("doc"), "semantic_score")
    out = ranked_search(index, docs, asked, model, semantic, lexical_top_n, semantic_top_n, rrf_k)
    return out.drop("corpus").withColumnRenamed("search", group).withColumnRenamed("doc", key)


def hits_from_documents(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored result lists: each ``source`` is one, documents keep their id order as the original result order.  A
    document whose id is a page's is a hit on that page; the others are known by their id alone."""
    links = pages.select(F.col("page_id").alias("doc_id"), "url")
    return documents.join(links, "doc_id", "left").select(
        F.col("source").alias("corpus"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("doc"),
        F.coalesce("url", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("href"),
        F.lit(None).cast("string").alias("title"), F.col("text").alias("body"))


def content_from_pages(pages: DataFrame) -> DataFrame:
    """What a fetch of each URL gives: the page's characters outside its tags, the author and date of its ``meta``
    tags.  Of several snapshots of a URL, the one with the largest id."""
    from .page_quality import AUTHOR, PUBLISHED, meta_content
    last = pages.groupBy("url").agg(F.max_by("html", "page_id").alias("html"))
    return last.select("url", F.col("url").alias("final_url"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"),
                       meta_content("html", *AUTHOR).alias("author"), meta_content("html", *PUBLISHED).alias("date"),
                       F.lit(None).cast("string").alias("sitename"))


def benchmark_queries(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """Every benchmark item is a search: ``search, corpus, query``.  Items and result lists are numbered in order, and
    item i asks list i modulo their number."""
    lists = positions(documents.select(F.col("source").alias("corpus")).where("source is not null").distinct(), ["corpus"], "at")
    n = lists.count()
    items = positions(benchmark.select("item_id", "text"), ["item_id"], "number")
    asked = items.select(F.col("item_id").alias("search"), F.coalesce("text", F.lit("")).alias("query"), (F.col("number") % max(n, 1)).alias("at"))
    return written(asked.join(lists, "at").select("search", "corpus", "query"), "search-queries")


def queries_of_pages(pages: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``page_id, query``: pages and benchmark items are numbered in order, and page i is asked item i modulo their
    number."""
    items = written(positions(benchmark.select(F.coalesce("text", F.lit("")).alias("query"), "item_id"), ["item_id"], "at"), "page-queries")
    numbered = positions(pages.select("page_id"), ["page_id"], "number").withColumn("at", F.col("number") % max(items.count(), 1))
    return numbered.join(items, "at").select("page_id", "query")


def search_with_cache(queries: DataFrame, cache: DataFrame, fresh_hits: DataFrame, now,
                      use_enhancement: bool = True, lexical_top_n: int = 100, semantic_top_n: int = 25,
                      content: DataFrame | None = None, semantic: DataFrame | None = None,
                      ttl_s: int = H.CACHE_TTL_S, max_results: int = 100, model: Callable | None = None) -> DataFrame:
    """C9 end to end over tables.

    ``queries(search_id, query)``; ``cache(cache_key, set_at, pos, href, title, body)``
    (one row per cached hit); ``fresh_hits(q, backend_priority, pos, href, title, body)``
    results per query variant ``q`` from each backend.  Steps: P13 variants ->
    J6/F11 cache lookup per variant (P12 key) -> S8 fallback for the misses ->
    U1/A2 merge and dedupe by href -> C9 ranking.
    """
    from ..functions import text as TX
    v = queries.select("search_id", "query",
                       F.explode(H.query_variants(F.col("query")) if use_enhancement else F.array("query")).alias("q"))
    v = v.withColumn("cache_key", TX.cache_key("q")).withColumn("_now", now)
    entries = cache.select("cache_key", "set_at").distinct()
    looked = H.cache_lookup(v, entries, "cache_key", "_now", "set_at", ttl_s=ttl_s)
    hit_rows = (looked.filter("cache_hit")
                      .join(cache.withColumnRenamed("set_at", "cache_set_at"), ["cache_key", "cache_set_at"])
                      .select("search_id", "q", "pos", "href", "title", "body"))
    misses = looked.filter(~F.col("cache_hit")).select("search_id", "q")
    fresh = H.backend_fallback(fresh_hits.join(misses, "q"), "q", "backend_priority", "pos", max_results)
    fresh = fresh.select("search_id", "q", "pos", "href", "title", "body")
    # Cached results enter first, then fresh ones; inside each, variants in text
    # order and hits by position.  A search holds at most variants x max_results
    # rows, so numbering them with a window per search is bounded.
    u = (hit_rows.withColumn("_fresh", F.lit(False)).unionByName(fresh.withColumn("_fresh", F.lit(True))))
    u = u.withColumn("seq", F.row_number().over(Window.partitionBy("search_id").orderBy("_fresh", "q", "pos"))
                     .cast("long")).drop("_fresh", "q", "pos")
    hits = H.dedupe_hits(u, ["search_id"], "href", "seq").withColumn("doc_key", F.col("href"))
    return high_precision_search(hits, queries.select("search_id", "query"), content=content, semantic=semantic,
                                 lexical_top_n=lexical_top_n, semantic_top_n=semantic_top_n, model=model)
