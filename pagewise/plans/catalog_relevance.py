"""Registered queries: relevance scoring (C8, A6, P15, P22, T4) and search-hit
operators (A2, S8, J6/F11, P28) over documents, benchmark, embeddings, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relevance as R
from ..operators import search as H
from ..operators.rank import top_n_per_group
from ..sources.tables import table
from .catalog import SQL_RRF, SQL_SEARCHES, r6, register, searched, searches, utc
from .sql_parts import words_sql


_JACCARD_CTE = f"""
jac AS (
  SELECT search, corpus, doc,
         CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
              ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard_score
  FROM (SELECT search, corpus, doc_id AS doc, list_distinct({words_sql("lower(coalesce(text, ''))")}) AS a,
               list_distinct({words_sql("lower(q.query)")}) AS b
        FROM documents JOIN q ON q.corpus = source))
"""

_TFIDF_CTE = r"""
it AS (SELECT source AS g, doc_id AS k, term, count(*) AS tf
       FROM (SELECT source, doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN_]{2,}')) AS term
             FROM documents) GROUP BY ALL),
grp AS (SELECT source AS g, count(*) + 1 AS n FROM documents GROUP BY 1),
qt AS (SELECT search, g, term, count(*) AS tf
       FROM (SELECT search, corpus AS g, unnest(regexp_extract_all(lower(query), '[\pL\pN_]{2,}')) AS term FROM q) GROUP BY ALL),
dfi AS (SELECT g, term, count(*) AS dfi FROM it GROUP BY ALL),
idf AS (SELECT search, g, term, ln((1 + n) / (1 + max(dfi) + max(own))) + 1 AS idf, max(own) AS own
        FROM (SELECT search, corpus AS g, term, dfi, 0 AS own FROM dfi JOIN q ON q.corpus = g
              UNION ALL SELECT search, g, term, 0, 1 FROM qt) JOIN grp USING (g) GROUP BY search, g, term, n),
qw AS (SELECT search, g, term, tf * idf AS w FROM qt JOIN idf USING (search, g, term)),
qnorm AS (SELECT search, sqrt(sum(w * w)) AS nq FROM qw GROUP BY ALL),
inorm AS (SELECT search, k, sqrt(sum(tf * idf * tf * idf)) AS ni FROM it JOIN idf USING (g, term) GROUP BY ALL),
dots AS (SELECT search, k, sum(tf * idf * qw.w) AS d FROM it JOIN idf USING (g, term) JOIN qw USING (search, g, term) GROUP BY ALL),
tfidf AS (
  SELECT q.search, q.corpus, x.doc_id AS doc,
         CASE WHEN ni > 0 AND nq > 0 AND dots.d IS NOT NULL THEN dots.d / (ni * nq) ELSE 0.0 END AS tfidf_score
  FROM documents x JOIN q ON q.corpus = x.source
  LEFT JOIN dots ON dots.search = q.search AND dots.k = x.doc_id
  LEFT JOIN inorm ON inorm.search = q.search AND inorm.k = x.doc_id
  LEFT JOIN qnorm ON qnorm.search = q.search)
"""


def _first_sql(name: str, score: str, more: str = "") -> str:
    """The first 100 documents with a score above 0 of each search."""
    return f"""SELECT search, doc AS doc_id, rnk{more}, round({score}, 6) AS {score} FROM (
  SELECT *, row_number() OVER (PARTITION BY search ORDER BY round({score}, 9) DESC, doc) - 1 AS rnk FROM {name} WHERE {score} > 0)
  WHERE rnk < 100"""


def _scored(spark: SparkSession, sf: str, *fields: str) -> tuple:
    from ..operators import inverted as I
    index = I.build_index(table(spark, sf, "documents").where("source is not null"), "source", "doc_id", "text", "doc_id", fields)
    asked = searches(spark, sf)
    return index, asked, I.relevance(index, asked)


def _first(scored: DataFrame, score: str, *more: str) -> DataFrame:
    top = top_n_per_group(scored.where(F.col(score) > 0), ["search"], [F.round(score, 9).desc(), F.col("doc").asc()], 100)
    return top.select("search", F.col("doc").alias("doc_id"), F.col("rank").cast("long").alias("rnk"),
                      *[r6(c).alias(c) for c in (*more, score)])


@register("jaccard", f"WITH {SQL_SEARCHES}, {_JACCARD_CTE} {_first_sql('jac', 'jaccard_score')}")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _first(_scored(spark, sf, "set")[2], "jaccard_score")


@register("tfidf_cosine", f"WITH {SQL_SEARCHES}, {_TFIDF_CTE} {_first_sql('tfidf', 'tfidf_score')}")
def tfidf_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _first(_scored(spark, sf, "word")[2], "tfidf_score")


_HYBRID = f"""WITH {SQL_SEARCHES}, {_JACCARD_CTE}, {_TFIDF_CTE},
hyb AS (SELECT search, corpus, doc, jaccard_score, tfidf_score, 0.0::DOUBLE AS semantic_score,
               0.2 * jaccard_score + 0.3 * tfidf_score + 0.5 * 0.0::DOUBLE AS relevance_score
        FROM jac JOIN tfidf USING (search, corpus, doc))
"""


@register("hybrid_relevance", _HYBRID + _first_sql(
    "hyb", "relevance_score", "".join(f", round({c}, 6) AS {c}" for c in ("jaccard_score", "tfidf_score", "semantic_score"))))
def hybrid_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return _first(_scored(spark, sf, "set", "word")[2], "relevance_score", "jaccard_score", "tfidf_score", "semantic_score")


@register("relevance_stats_sqs", _HYBRID + """,
st AS (SELECT search, corpus, count(*) AS result_count, avg(relevance_score) AS a, var_pop(relevance_score) AS v,
              max(relevance_score) AS m FROM hyb GROUP BY 1, 2),
sq AS (SELECT *, CASE WHEN result_count = 0 THEN 0.0
                      ELSE greatest(0.0, (ln(result_count + 1.0) * 0.2 + a * 0.4 - v * 0.2 + m * 0.2) * 100.0) END AS s
       FROM st)
SELECT search, corpus, result_count, round(a, 6) AS avg_relevance, round(v, 6) AS relevance_variance,
       round(m, 6) AS max_relevance, round(s, 6) AS sqs_score,
       CASE WHEN result_count = 0 THEN 'Invalid/Empty' WHEN s >= 60 THEN 'Valid'
            WHEN s >= 20 THEN 'Low Quality' ELSE 'Invalid/Empty' END AS quality_category
FROM sq
""")
def relevance_stats_sqs(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import inverted as I
    st = I.relevance_stats(*_scored(spark, sf, "set", "word"))
    return st.select("search", "corpus", "result_count", *[r6(c).alias(c) for c in
                     ("avg_relevance", "relevance_variance", "max_relevance", "sqs_score")], "quality_category")


@register("embedding_cosine", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n
           FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, x.vec_id, x.label, CASE WHEN q.n * x.n > 0 THEN list_dot_product(q.e, x.e) / (q.n * x.n) ELSE 0.0 END AS sc
      FROM e q, e x WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, label, semantic_rank, round(sc, 6) AS semantic_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sc, 9) DESC, vec_id) - 1 AS semantic_rank FROM s)
WHERE semantic_rank < 25
""")
def embedding_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector whose id 20 divides against all vectors."""
    e = table(spark, sf, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    top = R.embedding_cosine(e, asked)
    return top.join(e.select("vec_id", "label"), "vec_id").select(
        "query_id", "vec_id", "label", F.col("rank").cast("long").alias("semantic_rank"), r6("semantic_score").alias("semantic_score"))


@register("hit_dedupe", """
SELECT sha256(text) AS href, min(doc_id) AS seq, arg_max(source, doc_id) AS source, arg_max(lang, doc_id) AS lang
FROM documents GROUP BY 1
""")
def hit_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    hits = d.select(F.sha2("text", 256).alias("href"), F.col("doc_id").alias("seq"), "source", "lang")
    return H.dedupe_hits(hits, [], "href", "seq")


@register("backend_fallback", """
WITH h AS (SELECT lang AS q, source AS backend, CAST(substr(source, 4) AS INT) AS backend_priority, doc_id,
                  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS pos FROM documents),
b AS (SELECT q, min(backend_priority) AS best FROM h GROUP BY 1)
SELECT q, backend, pos, doc_id FROM h JOIN b USING (q) WHERE backend_priority = best AND pos <= 50
""")
def backend_fallback(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    hits = d.select(F.col("lang").alias("q"), F.col("source").alias("backend"),
                    F.expr("substr(source, 4)").cast("int").alias("backend_priority"), "doc_id")
    # positions only matter up to the cap, so the per-list numbering is a bounded top-n
    ranked = top_n_per_group(hits, ["q", "backend"], [F.col("doc_id").asc()], 50, rank_col="_r") \
        .withColumn("pos", (F.col("_r") + 1).cast("long"))
    out = H.backend_fallback(ranked, "q", "backend_priority", "pos", max_results=50)
    return out.select("q", "backend", "pos", "doc_id")


@register("cache_ttl_asof", """
WITH s AS (SELECT user_id, ts AS set_at FROM events WHERE event_type = 'view'),
r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT r.event_id,
       CASE WHEN r.ts < s.set_at + INTERVAL 3600 SECOND THEN strftime(s.set_at, '%Y-%m-%d %H:%M:%S.%f') END
         AS cache_set_at,
       coalesce(r.ts < s.set_at + INTERVAL 3600 SECOND, false) AS cache_hit
FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.set_at
""")
def cache_ttl_asof(spark: SparkSession, sf: str) -> DataFrame:
    utc(spark)
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    out = H.cache_replay(e, "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "click", ttl_s=3600)
    return out.select("event_id",
                      F.when(F.col("cache_hit"), F.date_format("cache_set_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
                      .alias("cache_set_at"), "cache_hit")


# Fixed value: the answer-prompt template of the search system.
PROMPT_HEAD = ("You are a research assistant. Based on the following multiple sources of information, "
               "please provide a comprehensive answer to the user's question.\n\n**Instructions:**\n"
               "* When creating your answer, **prioritize information from sources with the highest "
               "credibility score**.\n"
               "* If the content contradicts between sources, point out the contradiction and then **adopt the "
               "view of the source with the higher credibility score**.\n"
               "* Clearly indicate which source each part of your answer is based on by citing it "
               "(e.g., [Source 1], [Source 2]).\n\n**User Question:**\n")
PROMPT_MID = "\n\n**Information Sources:**\n"
PROMPT_TAIL = "\n**Your Answer:**"


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("llm_prompt", f"""
WITH {SQL_RRF},
blocks AS (
  SELECT search, final_rank,
         '--- Information Source ' || (final_rank + 1) || ' ---' || chr(10) ||
         'Title: N/A' || chr(10) || 'URL: ' || href || chr(10) ||
         'Final Score: ' || printf('%.4f', final_score) || ' (Credibility: ' ||
         printf('%.2f', cred) || ')' || chr(10) ||
         'Extracted Content:' || chr(10) || coalesce(body, 'No content extracted.') || chr(10) || chr(10) AS block
  FROM ranked)
SELECT search, {_sql_str(PROMPT_HEAD)} || q.query || {_sql_str(PROMPT_MID)} ||
       string_agg(block, '' ORDER BY final_rank) || {_sql_str(PROMPT_TAIL)} AS prompt
FROM blocks JOIN q USING (search) GROUP BY search, q.query
""")
def llm_prompt(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.digest import answer_prompt
    asked = searches(spark, sf)
    docs = searched(spark, sf, asked).join(asked.select("search", "query"), "search")
    return answer_prompt(docs, "search", "final_rank", PROMPT_HEAD, PROMPT_MID, PROMPT_TAIL)
