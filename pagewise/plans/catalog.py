"""Registered queries: one Spark DataFrame job per operator family of SURVEY §2,
each reading the given parquet tables in full, plus the DuckDB SQL that states
the same result independently (where SQL can express it).

Output columns are aliased identically on both sides; doubles are rounded to
6 decimals for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def utc(spark: SparkSession) -> None:
    """Date-time outputs are UTC strings (as the oracle's); make the session agree."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --------------------------------------------------------------------------------------
# Search (C9 chain: J7, A8a, T3, T5, A7, T6): every benchmark item asks one stored result list
# --------------------------------------------------------------------------------------

SQL_SEARCHES = """
lists AS (SELECT corpus, row_number() OVER (ORDER BY corpus) - 1 AS slot
          FROM (SELECT DISTINCT source AS corpus FROM documents WHERE source IS NOT NULL)),
q AS (SELECT item_id AS search, corpus, query
      FROM (SELECT item_id, coalesce(text, '') AS query, row_number() OVER (ORDER BY item_id) - 1 AS number FROM benchmark)
      JOIN lists ON slot = number % (SELECT count(*) FROM lists))
"""

# Hits as they were stored, and with the content of the page they lead to.
_SQL_HITS = "hits AS (SELECT source AS corpus, doc_id AS seq, doc_id AS doc, text AS body, 0.0::DOUBLE AS cred, 'doc:' || doc_id AS href FROM documents)"
_SQL_CONTENT = r"""
content AS (SELECT url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text,
                   least((CASE regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '[^.]*$', 0)
                               WHEN 'gov' THEN 0.3 WHEN 'edu' THEN 0.3 WHEN 'org' THEN 0.1 ELSE 0.0 END
                          + CASE WHEN starts_with(lower(url), 'https:') THEN 0.1 ELSE 0.0 END)::DOUBLE / 1.1, 1.0) AS cred
            FROM (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url)),
hits AS (SELECT source AS corpus, doc_id AS seq, doc_id AS doc, coalesce(c.text, d.text) AS body, coalesce(cred, 0.0) AS cred,
                coalesce(p.url, 'doc:' || doc_id) AS href
         FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN content c ON c.url = p.url)
"""

_SQL_BM25 = """
toks AS (SELECT corpus, doc, string_split(coalesce(body, ''), ' ') AS t FROM hits),
docs AS (SELECT corpus, doc, CAST(len(t) AS DOUBLE) AS dl FROM toks),
corpora AS (SELECT corpus, count(*) AS n, avg(dl) AS avgdl FROM docs GROUP BY 1),
tf AS (SELECT corpus, doc, term, count(*) AS tf FROM (SELECT corpus, doc, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3),
raw AS (SELECT corpus, term, ln(n - df + 0.5) - ln(df + 0.5) AS idf
        FROM (SELECT corpus, term, count(*) AS df FROM tf GROUP BY 1, 2) JOIN corpora USING (corpus)),
mean_idf AS (SELECT corpus, avg(idf) AS m FROM raw GROUP BY 1),
qidf AS (SELECT search, corpus, term, qtf, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf
         FROM (SELECT search, corpus, term, count(*) AS qtf
               FROM (SELECT search, corpus, unnest(string_split(query, ' ')) AS term FROM q) GROUP BY 1, 2, 3)
         JOIN raw USING (corpus, term) JOIN mean_idf USING (corpus)),
bm AS (SELECT q.search, h.corpus, h.doc, h.seq, coalesce(s.score, 0.0) AS bm25_score
       FROM q JOIN hits h USING (corpus) LEFT JOIN (
         SELECT search, doc, sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
         FROM tf JOIN qidf USING (corpus, term) JOIN docs USING (corpus, doc) JOIN corpora USING (corpus)
         GROUP BY 1, 2) s ON s.search = q.search AND s.doc = h.doc),
lex AS (SELECT * FROM (SELECT search, doc, bm25_score, row_number() OVER (PARTITION BY search ORDER BY round(bm25_score, 9) DESC, seq) - 1
                       AS rnk FROM bm) WHERE rnk < 100)
"""

SQL_RRF = f"{SQL_SEARCHES}, {_SQL_CONTENT}, {_SQL_BM25}" + """,
cred AS (SELECT corpus, doc, row_number() OVER (PARTITION BY corpus ORDER BY cred DESC, seq) - 1 AS rnk FROM hits),
fused AS (SELECT search, doc, sum(CAST(1 AS DOUBLE) / (60 + rnk + 1)) AS rrf
          FROM (SELECT search, doc, rnk FROM lex UNION ALL SELECT search, doc, rnk FROM lex
                UNION ALL SELECT search, doc, rnk FROM q JOIN cred USING (corpus)) GROUP BY 1, 2),
ranked AS (SELECT * FROM (SELECT b.search, b.corpus, b.doc, h.href, h.body, h.cred, b.bm25_score, f.rrf AS final_score,
                  row_number() OVER (PARTITION BY b.search ORDER BY round(f.rrf, 9) DESC, b.seq) - 1 AS final_rank
           FROM bm b JOIN fused f USING (search, doc) JOIN hits h USING (corpus, doc)) WHERE final_rank < 25)
"""


def searches(spark: SparkSession, sf: str) -> DataFrame:
    from .search import benchmark_queries
    return benchmark_queries(table(spark, sf, "benchmark"), table(spark, sf, "documents"))


def searched(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    """C9 over hits with their content for every search."""
    from ..operators.inverted import build_index
    from ..session import written
    from .search import content_from_pages, enriched, hits_from_documents, ranked_search
    pages = table(spark, sf, "pages")
    docs = written(enriched(hits_from_documents(table(spark, sf, "documents"), pages), content_from_pages(pages)), "search-docs")
    return ranked_search(build_index(docs, "corpus", "doc", "body", "seq", ("space",)), docs, asked)


@register("search_rrf", f"WITH {SQL_RRF}" + """
SELECT search, final_rank, doc AS doc_id, round(final_score, 6) AS final_score, round(bm25_score, 6) AS bm25_score,
       round(cred, 6) AS credibility_score, href FROM ranked
""")
def search_rrf(spark: SparkSession, sf: str) -> DataFrame:
    res = searched(spark, sf, searches(spark, sf))
    return res.select("search", F.col("final_rank").cast("long").alias("final_rank"), F.col("doc").alias("doc_id"),
                      r6("final_score").alias("final_score"), r6("bm25_score").alias("bm25_score"),
                      r6("credibility_score").alias("credibility_score"), "href")


@register("bm25_topk", f"WITH {SQL_SEARCHES}, {_SQL_HITS}, {_SQL_BM25}" + """
SELECT search, rnk AS bm25_rank, doc AS doc_id, round(bm25_score, 6) AS bm25_score FROM lex
""")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.inverted import bm25_top, build_index
    index = build_index(table(spark, sf, "documents").where("source is not null"), "source", "doc_id", "text", "doc_id", ("space",))
    top = bm25_top(index, searches(spark, sf), 100)
    return top.select("search", F.col("rank").cast("long").alias("bm25_rank"), F.col("doc").alias("doc_id"),
                      r6("bm25_score").alias("bm25_score"))


from . import catalog_scalar  # noqa: E402,F401  (registers more queries)
from . import catalog_relevance  # noqa: E402,F401
from . import catalog_dom  # noqa: E402,F401
