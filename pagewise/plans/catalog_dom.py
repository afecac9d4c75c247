"""Registered queries over ``pages``: DOM nodes, main content, quality, pagination,
robots, fingerprints, monitoring.

The parsed and prepared node tables are checkpointed once per (session, data
folder) and shared by the queries of that folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dom_scores as DS
from ..functions import text as TX
from ..operators import pagination as PG
from ..operators import quality as Q
from ..sources.tables import table
from . import full_scan as FS
from . import monitoring as MON
from .catalog import r6, register, utc
from .catalog_scalar import NOW
from .sql_parts import words_sql

_CACHE: dict = {}


def _prepared(spark: SparkSession, sf: str):
    utc(spark)
    files = spark.read.parquet(f"{sf.rstrip('/')}/pages.parquet").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = files.distinct().agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _CACHE:
        pages = table(spark, sf, "pages").select("page_id", "url", "html")
        nodes, prep = FS.prepare(pages)
        _CACHE[key] = (pages, nodes, prep, {})
    return _CACHE[key]


def _main(spark, sf, profile=DS.CURRENT):
    pages, nodes, prep, memo = _prepared(spark, sf)
    k = ("main", profile.name)
    if k not in memo:
        from ..session import cut_lineage
        memo[k] = cut_lineage(FS.main_content(pages, prep, nodes, profile=profile))
    return memo[k]


def _analysis(spark, sf):
    pages, nodes, prep, memo = _prepared(spark, sf)
    if "analysis" not in memo:
        from ..session import cut_lineage
        mc = _main(spark, sf)
        pl = MON.page_links(nodes, pages)
        base = pages.select("page_id", "url").join(pl, "page_id", "left") \
                    .withColumn("next_url", PG.next_url("url", "page_links"))
        memo["analysis"] = cut_lineage(base.join(mc.drop("url", "web_type"), "page_id", "left"))
    return memo["analysis"]


# ---- S6, P9, A10, P7 -------------------------------------------------------------------------

@register("dom_nodes")
def dom_nodes(spark: SparkSession, sf: str) -> DataFrame:
    _, nodes, _, _ = _prepared(spark, sf)
    return nodes.drop("attributes")


@register("css_selector")
def css_selector(spark: SparkSession, sf: str) -> DataFrame:
    _, _, prep, _ = _prepared(spark, sf)
    return prep.select("page_id", "node_id", "tag", "depth", "css_selector", "text_len", "n_links", "n_words",
                       F.col("rect.x").alias("x"), F.col("rect.y").alias("y"),
                       F.col("rect.width").alias("width"), F.col("rect.height").alias("height"))


# DuckDB: hrefs of <a> tags in document order, resolved like the browser does for
# absolute, scheme-relative, root-relative and plain relative links.
_ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_LINKS_SQL = f"""
links AS (
  SELECT page_id, url, list_sort(list_transform(
           list_filter(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda x: x <> ''),
           lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x
                     WHEN starts_with(x, '//') THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || ':' || x
                     WHEN starts_with(x, '/') THEN {_ORIGIN} || x
                     ELSE {_ORIGIN} || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '[^/]*$', '') || x
                END)) AS links
  FROM pages)
"""
_PY_REPR = ("'[' || array_to_string(list_transform(links, lambda x: CASE "
            "WHEN contains(x, '''') AND NOT contains(x, '\"') THEN '\"' || replace(x, '\\', '\\\\') || '\"' "
            "ELSE '''' || replace(replace(x, '\\', '\\\\'), '''', '\\''') || '''' END), ', ') || ']'")


@register("subtree_links", f"WITH {_LINKS_SQL} SELECT page_id, links AS page_links FROM links")
def subtree_links(spark: SparkSession, sf: str) -> DataFrame:
    pages, nodes, _, _ = _prepared(spark, sf)
    return MON.page_links(nodes, pages)


@register("link_fingerprint", f"WITH {_LINKS_SQL} SELECT page_id, sha256({_PY_REPR}) AS result_vl FROM links")
def link_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    pages, nodes, _, _ = _prepared(spark, sf)
    return MON.page_links(nodes, pages).select("page_id", TX.link_fingerprint("page_links").alias("result_vl"))


@register("change_diff", f"""
WITH {_LINKS_SQL},
raw AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda x: x <> '') AS l
        FROM pages),
before AS (SELECT page_id AS row_id, sha256('[' || array_to_string(list_transform(l, lambda x: '''' || x || ''''), ', ')
                  || ']') AS old_vl FROM raw),
after AS (SELECT page_id AS row_id, url, sha256({_PY_REPR}) AS new_vl FROM links)
SELECT row_id, url FROM after JOIN before USING (row_id) WHERE old_vl IS DISTINCT FROM new_vl
""")
def change_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The stored fingerprint is of the raw hrefs in document order (an older
    snapshot format); the new one is of the resolved, sorted links."""
    pages, nodes, _, _ = _prepared(spark, sf)
    raw = (nodes.filter((F.col("tag") == "a") & F.col("href").isNotNull() & (F.col("href") != ""))
                .groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "href"))).alias("_h"))
                .select(F.col("page_id").alias("row_id"),
                        TX.link_fingerprint(F.transform("_h", lambda s: s["href"])).alias("result_vl")))
    before = pages.select(F.col("page_id").alias("row_id")).join(raw, "row_id", "left") \
                  .withColumn("result_vl", F.coalesce("result_vl", TX.link_fingerprint(F.array().cast("array<string>"))))
    after = MON.page_links(nodes, pages).join(pages.select("page_id", "url"), "page_id") \
               .select(F.col("page_id").alias("row_id"), "url", TX.link_fingerprint("page_links").alias("result_vl"))
    return MON.changes(before, after)


# ---- pagination ---------------------------------------------------------------------------

_NEXT_SQL = f"""
num AS (
  SELECT page_id, url, links,
         (SELECT max({{'n': CAST(regexp_extract(l, '(page[-=/]?)(\\d+)', 2) AS BIGINT), 'neg_pos': -i}})
          FROM (SELECT unnest(links) AS l, unnest(range(len(links))) AS i)
          WHERE regexp_extract(l, '(page[-=/]?)(\\d+)', 2) <> '') AS best
  FROM links),
nxt AS (
  SELECT page_id, url, links,
         CASE WHEN regexp_matches(url, 'page[-=/]?\\d+') AND best IS NOT NULL
                   AND best.n > coalesce(CAST(nullif(regexp_extract(url, '(page[-=/]?)(\\d+)', 2), '') AS BIGINT), -1)
              THEN links[-best.neg_pos + 1] END AS newest
  FROM num)
"""


@register("next_page", f"""
WITH {_LINKS_SQL}, {_NEXT_SQL}
SELECT page_id,
       CASE WHEN regexp_matches(url, 'page[-=/]?\\d+') THEN 'page_changer' ELSE 'plane' END AS web_type,
       CASE WHEN newest IS DISTINCT FROM url THEN newest END AS next_url,
       regexp_matches(url, 'page[-=/]?\\d+') AND list_has_any(list_transform(links, lambda x: regexp_matches(x, 'page[-=]\\d+')), [true])
         AS should_check_update
FROM nxt
""")
def next_page(spark: SparkSession, sf: str) -> DataFrame:
    pages, nodes, _, _ = _prepared(spark, sf)
    pl = MON.page_links(nodes, pages).join(pages.select("page_id", "url"), "page_id")
    return pl.select("page_id", PG.web_type("url").alias("web_type"),
                     PG.next_url("url", "page_links").alias("next_url"),
                     PG.should_check_update("url", "page_links").alias("should_check_update"))


# Numbered series derived from the pages: page p heads 1 + p % 5 pages /s<p>/page-<k>, each with a link to the one before
# it and to the next; where 7 divides p the last one links to a page that is not there.  Of each host, robots rules
# close all series whose path begins like its smallest id's, and the second page of its largest id's series.
_SERIES_SQL = r"""
heads AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://([^/?#]*))', 1) AS origin,
                 regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://([^/?#]*))', 2) AS host, 1 + page_id % 5 AS len FROM pages),
series AS (SELECT *, '/s' || page_id || '/page-' || k AS path FROM (SELECT *, unnest(range(1, len + 1)) AS k FROM heads)),
closed AS (SELECT host, '/s' || min(page_id) AS prefix FROM heads GROUP BY 1
           UNION ALL SELECT host, '/s' || max(page_id) || '/page-2' FROM heads GROUP BY 1),
snap AS (SELECT origin || path AS url, NOT EXISTS (SELECT 1 FROM closed c WHERE c.host = s.host AND starts_with(s.path, c.prefix)) AS allowed,
                CASE WHEN k < len OR page_id % 7 = 0 THEN origin || '/s' || page_id || '/page-' || (k + 1) END AS nxt FROM series s)
"""


def _series(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``(pages, robots)`` of the numbered series."""
    from ..functions import urls as U
    heads = table(spark, sf, "pages").select(
        "page_id", F.concat(U.scheme("url"), F.lit("://"), U.netloc("url")).alias("origin"), U.netloc("url").alias("host"),
        (F.col("page_id") % 5 + 1).cast("int").alias("len"))
    k = heads.select("*", F.explode(F.sequence(F.lit(1), F.col("len"))).alias("k"))

    def at(n):
        return F.concat(F.lit("/s"), F.col("page_id").cast("string"), F.lit("/page-"), n.cast("string"))

    def link(n):
        return F.concat(F.lit('<p><a href="'), at(n), F.lit('">another part</a> of these words</p>'))
    more = (F.col("k") < F.col("len")) | (F.col("page_id") % 7 == 0)
    html = F.concat(F.lit("<html><body><main><h1>part</h1>"), F.when(F.col("k") > 1, link(F.col("k") - 1)).otherwise(F.lit("")),
                    F.when(more, link(F.col("k") + 1)).otherwise(F.lit("")), F.lit("</main></body></html>"))
    pages = k.select((F.col("page_id") * 10 + F.col("k")).alias("page_id"), F.concat("origin", at(F.col("k"))).alias("url"), html.alias("html"))
    robots = heads.groupBy("host").agg(F.concat(
        F.lit("User-agent: *\nDisallow: /s"), F.min("page_id").cast("string"),
        F.lit("\nDisallow: /s"), F.max("page_id").cast("string"), F.lit("/page-2\n")).alias("robots_txt"))
    return pages, robots


@register("pagination_chain", f"""
WITH RECURSIVE {_SERIES_SQL},
walk AS (SELECT url, url AS cur, 0 AS hops FROM snap
         UNION ALL SELECT w.url, s.nxt, hops + 1 FROM walk w JOIN snap s ON s.url = w.cur WHERE s.allowed AND s.nxt IS NOT NULL AND hops < 3),
ends AS (SELECT url, arg_max(cur, hops) AS final_url, max(hops) AS hops FROM walk GROUP BY 1)
SELECT ends.url, final_url, hops, coalesce(snap.allowed, false) AS chain_ok FROM ends LEFT JOIN snap ON snap.url = final_url
""")
def pagination_chain(spark: SparkSession, sf: str) -> DataFrame:
    """J5 with J11/F5: every page of the series is a request; hops 0 to 3, blocked and missing pages."""
    from ..sources.html_nodes import html_to_nodes
    pages, robots = _series(spark, sf)
    found = MON.page_links(html_to_nodes(pages), pages).join(pages.select("page_id", "url"), "page_id")
    found = found.select("page_id", "url", PG.next_url("url", "page_links").alias("next_url"))
    return PG.follow_chain(pages.select("url"), MON.with_robots(found, robots)).select("url", "final_url", "hops", "chain_ok")


# ---- main content, quality ----------------------------------------------------------------

@register("candidates")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    _, _, prep, _ = _prepared(spark, sf)
    c = FS.candidates(prep)
    from pyspark.sql import Window
    w = Window.partitionBy("page_id").orderBy(F.col("cand_score").desc(), "depth", "node_id")
    return c.select("page_id", "node_id", "tag", "css_selector", r6("cand_score").alias("cand_score"),
                    (F.row_number().over(w) - 1).alias("cand_rank"))


def _main_out(df: DataFrame) -> DataFrame:
    return df.select("page_id", "node_id", "tag", "css_selector", "css_selector_list", "moves",
                     F.col("score").alias("score"), "web_type", F.length("text").alias("text_chars"),
                     F.size("links").alias("n_links"))


@register("main_content")
def main_content(spark: SparkSession, sf: str) -> DataFrame:
    return _main_out(_main(spark, sf))


@register("main_content_legacy")
def main_content_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return _main_out(_main(spark, sf, DS.LEGACY))


# Results pages derived from the documents: each dozen of ids is one page, every document a list item of its class, with a
# link unless 7 divides its id; what else is on the page goes by the page's number.
DOZEN = 12
_RESULTS_SQL = f"""
items AS (SELECT doc_id // {DOZEN} AS page_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ad' ELSE 'hit' END AS cls, doc_id % 7 <> 0 AS linked,
                 CASE WHEN doc_id % 7 <> 0 THEN 'more ' ELSE '' END || coalesce(text, '') AS t FROM documents),
sized AS (SELECT *, len({words_sql("t")}) AS n_words FROM items),
box AS (SELECT page_id, count(*) AS n, greatest(count(*) FILTER (cls = 'hit'), count(*) FILTER (cls = 'ad')) AS rep FROM items GROUP BY 1),
valid AS (SELECT s.* FROM sized s JOIN box USING (page_id) WHERE linked AND n_words >= 10 AND n >= 2 AND rep > 1),
flags AS (SELECT page_id, page_id % 4 NOT IN (1, 2) AS is_no_results FROM box)
"""


def _results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(pages, nodes, prepared, main)`` of the results pages; the list of results is the main content."""
    from ..operators import dom as DOM
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    link = F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit('<a href="/d/'), F.col("doc_id").cast("string"), F.lit('">more</a> '))).otherwise(F.lit(""))
    item = F.concat(F.lit('<li class="'), F.when(F.col("doc_id") % 5 == 0, "ad").otherwise("hit"), F.lit('">'), link, TX.html_escape("text"), F.lit("</li>"))
    # a page is a dozen items
    lists = d.groupBy(F.expr(f"doc_id div {DOZEN}").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("li")))).alias("l"))
    more = F.element_at(F.array(*(F.lit(x) for x in (
        '<p class="x no-results">-</p>', '<ul class="search-results"></ul>', '<div id="search-results-container"></div>', ""))),
        (F.col("page_id") % 4 + 1).cast("int"))
    pages = lists.select("page_id", F.concat(F.lit("https://find.example.org/q/"), F.col("page_id").cast("string")).alias("url"),
                         F.concat(F.lit('<html><body><h1>found</h1><ol id="found">'), F.array_join(F.transform("l", lambda x: x["li"]), ""),
                                  F.lit("</ol>"), more, F.lit("</body></html>")).alias("html"))
    nodes, prep = FS.prepare(pages)
    found = prep.filter("id = 'found'").select("page_id", "node_id", "subtree_end", "tag", "css_selector", "url")
    text = DOM.subtree_text(nodes, found.select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end")))
    return pages, nodes, prep, found.join(text.select("page_id", "text"), "page_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


@register("result_container", f"""
WITH {_RESULTS_SQL}
SELECT page_id, 'ol#found' AS css_selector, round(rep * rep / n, 6) AS container_score, n AS n_children FROM box WHERE n >= 2 AND rep > 1
""")
def result_container(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4 over the results pages."""
    _, _, prep, main = _results(spark, sf)
    c = Q.result_container(prep, main)
    own = prep.select("page_id", F.col("node_id").alias("container_id"), "css_selector")
    return c.join(own, ["page_id", "container_id"]).select("page_id", "css_selector", r6("container_score").alias("container_score"), "n_children")


@register("result_items", f"""
WITH {_RESULTS_SQL}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY doc_id) AS pos, CAST(n_words AS INT) AS n_words, 1 AS n_links FROM valid
""")
def result_items(spark: SparkSession, sf: str) -> DataFrame:
    """F3, J3, A5 over the results pages: the valid items of each in document order."""
    from pyspark.sql import Window
    _, _, prep, main = _results(spark, sf)
    items = Q.result_items(prep, Q.result_container(prep, main))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).cast("long")      # a page's items
    return items.select("page_id", pos.alias("pos"), "n_words", "n_links")


@register("no_results", f"WITH {_RESULTS_SQL} SELECT page_id, is_no_results FROM flags")
def no_results(spark: SparkSession, sf: str) -> DataFrame:
    """F4 over the results pages: selectors for none, for some, and neither."""
    pages, _, prep, main = _results(spark, sf)
    return Q.no_results(main, prep, pages)


@register("page_quality", f"""
WITH {_RESULTS_SQL},
numbered AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS number FROM box),
q AS (SELECT page_id, query FROM numbered JOIN (SELECT coalesce(text, '') AS query, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM benchmark)
      ON slot = number % (SELECT count(*) FROM benchmark)),
jac AS (SELECT page_id, doc_id, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0
               ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard
        FROM (SELECT page_id, doc_id, list_distinct({words_sql("lower(t)")}) AS a, list_distinct({words_sql("lower(query)")}) AS b
              FROM valid JOIN q USING (page_id))),
tf AS (SELECT page_id, doc_id, term, count(*) AS tf
       FROM (SELECT page_id, doc_id, unnest(regexp_extract_all(lower(t), '[\\pL\\pN_]{{2,}}')) AS term FROM valid) GROUP BY ALL),
qt AS (SELECT page_id, term, count(*) AS tf
       FROM (SELECT page_id, unnest(regexp_extract_all(lower(query), '[\\pL\\pN_]{{2,}}')) AS term FROM q) GROUP BY ALL),
idf AS (SELECT page_id, term, ln((2 + n) / (1 + count(*))) + 1 AS idf
        FROM (SELECT page_id, term FROM tf UNION ALL SELECT page_id, term FROM qt)
        JOIN (SELECT page_id, count(*) AS n FROM valid GROUP BY 1) USING (page_id) GROUP BY page_id, term, n),
norms AS (SELECT page_id, doc_id, sqrt(sum(tf * idf * tf * idf)) AS ni FROM tf JOIN idf USING (page_id, term) GROUP BY ALL),
qnorm AS (SELECT page_id, sqrt(sum(tf * idf * tf * idf)) AS nq FROM qt JOIN idf USING (page_id, term) GROUP BY ALL),
dots AS (SELECT page_id, doc_id, sum(tf.tf * idf * qt.tf * idf) AS d FROM tf JOIN idf USING (page_id, term) JOIN qt USING (page_id, term) GROUP BY ALL),
scored AS (SELECT page_id, doc_id, 0.2 * jaccard + 0.3 * CASE WHEN ni > 0 AND nq > 0 AND d IS NOT NULL THEN d / (ni * nq) ELSE 0.0 END AS r
           FROM jac LEFT JOIN norms USING (page_id, doc_id) LEFT JOIN qnorm USING (page_id) LEFT JOIN dots USING (page_id, doc_id)),
st AS (SELECT page_id, count(*) AS c, avg(r) AS a, var_pop(r) AS v, max(r) AS m FROM scored GROUP BY 1),
ev AS (SELECT f.page_id, is_no_results OR coalesce(c, 0) = 0 AS is_empty, coalesce(c, 0) AS result_count,
              greatest(0.0, (ln(c + 1.0) * 0.2 + a * 0.4 - v * 0.2 + m * 0.2) * 100.0) AS s FROM flags f LEFT JOIN st USING (page_id))
SELECT page_id, 'ol' AS title, is_empty AS is_empty_result, result_count, CASE WHEN NOT is_empty THEN round(s, 6) END AS sqs_score,
       CASE WHEN is_empty THEN NULL WHEN s >= 60 THEN 'Valid' WHEN s >= 20 THEN 'Low Quality' ELSE 'Invalid/Empty' END AS quality_category,
       CASE WHEN is_empty THEN 'EMPTY' WHEN s >= 20 AND s < 60 THEN 'LOW QUALITY' ELSE 'INVALID' END AS label
FROM ev
""")
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    """C6, C7's labels over the results pages, each asked one benchmark item."""
    from .page_quality import evaluate, validate
    from .search import queries_of_pages
    pages, nodes, prep, main = _results(spark, sf)
    q = queries_of_pages(pages, table(spark, sf, "benchmark"))
    ev = evaluate(pages, q, nodes, prep, main=main).join(q, "page_id")
    return validate(ev).select("page_id", "title", "is_empty_result", "result_count", r6("sqs_score").alias("sqs_score"), "quality_category", "label")


# Pages with metadata derived from the pages: by its number a page names its author and date in one order of
# attributes and quotes or another, or not at all; of every third one an extractor knows the author already.
_HEADS = ('<meta name="author" content="Writer {0}"><meta property="article:published_time" content="2020-01-0{0}">',
          "<META content='Writer {0}' class=x name='author'>", "<meta content=2021-05-0{0} property=article:published_time>",
          '<!-- <meta name="author" content="nobody"> --><meta name="author" content="">')


@register("content_processing", """
WITH p AS (SELECT page_id, url, page_id % 4 AS kind, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
m AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'Found ' || page_id WHEN kind < 2 THEN 'Writer ' || kind END AS author,
             CASE kind WHEN 0 THEN '2020-01-00' WHEN 2 THEN '2021-05-02' END AS date FROM p)
SELECT page_id, url AS final_url, author, date, host AS sitename, CAST(length(url) AS INT) AS text_chars,
       round(least((CASE regexp_extract(host, '[^.]*$', 0) WHEN 'gov' THEN 0.3 WHEN 'edu' THEN 0.3 WHEN 'org' THEN 0.1 ELSE 0.0 END
                    + CASE WHEN author IS NOT NULL THEN 0.15 ELSE 0.0 END + CASE WHEN date IS NOT NULL THEN 0.15 ELSE 0.0 END
                    + CASE WHEN starts_with(lower(url), 'https:') THEN 0.1 ELSE 0.0 END)::DOUBLE / 1.1, 1.0), 6) AS credibility_score
FROM m
""")
def content_processing(spark: SparkSession, sf: str) -> DataFrame:
    """C10, P24, P14 over pages with metadata."""
    from .page_quality import process_content
    kind = (F.col("page_id") % 4).cast("int")
    head = F.element_at(F.array(*(F.lit(h.format(i)) for i, h in enumerate(_HEADS))), kind + 1)
    pages = table(spark, sf, "pages").select("page_id", "url", F.concat(F.lit("<html><head>"), head, F.lit("</head>"), "html").alias("html"))
    found = pages.where("page_id % 3 = 0").select("page_id", F.concat(F.lit("Found "), F.col("page_id").cast("string")).alias("author"),
                                                  F.lit("").alias("date"), F.lit(None).cast("string").alias("sitename"))
    pc = process_content(pages, pages.select("page_id", F.col("url").alias("text")), found)
    return pc.select("page_id", "final_url", "author", "date", "sitename", F.length("text").alias("text_chars"),
                     r6("credibility_score").alias("credibility_score"))


# ---- robots -------------------------------------------------------------------------------

# A robots file applied to every host of the snapshot table (the reference fetches one per host).
ROBOTS_TXT = "User-agent: *\nDisallow: /fr/\nAllow: /en/\nDisallow: /es/1\n\nUser-agent: *\nDisallow: /en/"


_ROBOTS_SQL = "'" + ROBOTS_TXT.replace("\n", "' || chr(10) || '") + "'"


ORACLE_ROBOTS_FILTER = f"""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
lines AS (SELECT host, unnest(string_split({_ROBOTS_SQL}, chr(10))) AS line,
                 unnest(range(len(string_split({_ROBOTS_SQL}, chr(10))))) AS pos FROM hosts),
c AS (SELECT host, pos, trim(regexp_replace(line, '#.*$', '')) AS c FROM lines),
p AS (SELECT host, pos, lower(trim(split_part(c, ':', 1))) AS k, trim(substr(c, strpos(c, ':') + 1)) AS v
      FROM c WHERE strpos(c, ':') > 0),
p2 AS (SELECT * FROM p WHERE k IN ('user-agent', 'allow', 'disallow', 'crawl-delay', 'request-rate')),
g AS (SELECT *, sum(CASE WHEN k = 'user-agent' AND (prev_k IS NULL OR prev_k <> 'user-agent') THEN 1 ELSE 0 END)
                  OVER (PARTITION BY host ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp
      FROM (SELECT *, lag(k) OVER (PARTITION BY host ORDER BY pos) AS prev_k FROM p2)),
star AS (SELECT host, min(grp) AS grp FROM g WHERE k = 'user-agent' AND v = '*' GROUP BY 1),
rules AS (SELECT g.host, g.pos, (k = 'allow' OR v = '') AS allow, v AS prefix FROM g JOIN star USING (host, grp)
          WHERE k IN ('allow', 'disallow')),
pg AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
              coalesce(nullif(regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1),
                                             ';[^/]*$', ''), ''), '/') AS path
       FROM pages),
hit AS (SELECT page_id, arg_min(allow, pos) AS a FROM pg JOIN rules USING (host)
        WHERE starts_with(path, prefix) GROUP BY 1)
SELECT page_id, coalesce(a, true) AS allowed FROM pg LEFT JOIN hit USING (page_id)
"""


@register("robots_filter", ORACLE_ROBOTS_FILTER)
def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions import urls as U
    from ..operators.robots import allowed
    pages = table(spark, sf, "pages").select("page_id", "url")
    robots = pages.select(U.netloc("url").alias("host")).distinct().withColumn("robots_txt", F.lit(ROBOTS_TXT))
    return allowed(pages.withColumn("host", U.netloc("url")), robots, "host").select("page_id", "allowed")


# ---- monitoring ---------------------------------------------------------------------------

def _first_watch(pages: DataFrame) -> DataFrame:
    from ..sources.watchlist import normalize
    return normalize(pages.select(F.col("page_id").alias("row_id"), "url"))


# A watch list derived from the pages: times of the last full scan in several shapes (with an offset, without, legacy, none),
# all page types, rows with and without selectors.
_SCANNED = ("", "2024-02-27T12:00:00Z", "2024-02-25T00:00:00+09:00", "2024-02-28 00:00:00", "2024/02/28", None)
_TYPES = ("", "plane", "page_changer", "WebType.not_quickscan")


@register("scan_decision", f"""
WITH w AS (SELECT page_id AS row_id, page_id % 6 AS t, page_id % 4 AS k, page_id % 5 <> 0 AS listed FROM pages),
a AS (SELECT *, CASE t WHEN 1 THEN CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(TIMESTAMP '2024-02-27 12:00:00')) / 86400000000.0) AS BIGINT)
                       WHEN 2 THEN CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(TIMESTAMP '2024-02-24 15:00:00')) / 86400000000.0) AS BIGINT)
                       WHEN 4 THEN CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(TIMESTAMP '2024-02-28 00:00:00')) / 86400000000.0) AS BIGINT)
                       ELSE 99 END AS scan_age_days FROM w)
SELECT row_id, scan_age_days, listed AND scan_age_days < 4 AND k <> 0 AS quick_eligible,
       CASE WHEN listed AND scan_age_days < 4 AND k = 1 THEN 'quick' WHEN listed AND scan_age_days < 4 AND k > 1 THEN 'quick_full' ELSE 'full' END AS scan_mode
FROM a
""")
def scan_decision(spark: SparkSession, sf: str) -> DataFrame:
    """F7, P8."""
    from ..sources.watchlist import normalize
    utc(spark)

    def pick(values, n):
        return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (F.col("page_id") % n + 1).cast("int"))
    listed = F.when(F.col("page_id") % 5 != 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>"))
    watch = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), "url", pick(_SCANNED, 6).alias("full_scan_datetime"),
                                             pick(_TYPES, 4).alias("web_page_type"), listed.alias("css_selector_list"))
    d = MON.scan_decision(normalize(watch), F.lit(NOW).cast("timestamp"))
    return d.select("row_id", "scan_age_days", "quick_eligible", "scan_mode")


def _run_state(spark, sf):
    pages, nodes, prep, memo = _prepared(spark, sf)
    if "run1" not in memo:
        from ..session import cut_lineage
        now = F.lit(NOW).cast("timestamp")
        new, changed, errors = MON.monitoring_run(_first_watch(pages), pages, now, nodes, prep,
                                                  analysis=_analysis(spark, sf))
        memo["run1"] = cut_lineage(new)
    return memo["run1"]


@register("quick_scan")
def quick_scan(spark: SparkSession, sf: str) -> DataFrame:
    pages, nodes, prep, _ = _prepared(spark, sf)
    q = MON.quick_scan(_run_state(spark, sf), pages, nodes, prep)
    return q.select("row_id", "node_id", "tag", "css_selector", "css_selector_list", "result_web_type",
                    F.length("text").alias("text_chars"), F.size("links").alias("n_links"))


@register("monitor_run")
def monitor_run(spark: SparkSession, sf: str) -> DataFrame:
    """C5 twice: a first run over an empty watch list (all full scans), then a second
    run two days later over snapshots whose articles gained a link (quick scans)."""
    pages, nodes, prep, _ = _prepared(spark, sf)
    state1 = _run_state(spark, sf)
    pages2 = pages.withColumn("html", F.regexp_replace("html", "</article>", '<a href="/next-edition">more</a></article>'))
    now2 = F.lit("2024-03-03 00:00:00").cast("timestamp")
    new, changed, errors = MON.monitoring_run(state1, pages2, now2)
    flag = changed.select("row_id", F.lit(True).alias("changed"))
    return (new.join(flag, "row_id", "left").withColumn("changed", F.coalesce("changed", F.lit(False)))
               .select("row_id", "url", "result_vl", "updated_datetime", "full_scan_datetime", "css_selector_list",
                       "web_page_type", "run_code", "changed"))


# ---- X2 streaming ---------------------------------------------------------------------------

@register("stream_changes")
def stream_changes(spark: SparkSession, sf: str) -> DataFrame:
    """X2 over the pages table read as a file stream, be it one file or a folder of files (all that are there when the
    query starts are one micro-batch)."""
    from ..streaming import changes as X2
    # a pattern, as Spark does not stream from the plain path of a single file
    q, root = X2.start(spark, f"{sf.rstrip('/')}/pages.parque[t]", now=F.lit(NOW).cast("timestamp"))
    q.awaitTermination()
    return X2.read_changes(spark, root).select("url", "new_url", "result_vl", "is_new", "batch_id")


# ---- S10 / S11 digests ------------------------------------------------------------------------

_ITEM_SQL = ("'<li><p>\"' || url || '\"</p><a href=\"' || url || '\" target=\"_blank\">リンクを開く</a><br>'"
             " || '<p>(スクリーンショット取得失敗)</p></li>'")


@register("digest", f"""
WITH {_LINKS_SQL},
raw AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), lambda x: x <> '') AS l
        FROM pages),
before AS (SELECT page_id AS row_id, sha256('[' || array_to_string(list_transform(l, lambda x: '''' || x || ''''), ', ')
                  || ']') AS old_vl FROM raw),
after AS (SELECT page_id AS row_id, url, sha256({_PY_REPR}) AS new_vl FROM links),
ch AS (SELECT row_id, url FROM after JOIN before USING (row_id) WHERE old_vl IS DISTINCT FROM new_vl),
it AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, row_id, {_ITEM_SQL} AS line FROM ch)
SELECT domain, 1 AS section, CAST(row_id AS BIGINT) AS pos, line FROM it
UNION ALL SELECT DISTINCT domain, 0, CAST(NULL AS BIGINT), '<html><body><h2>更新ページ一覧</h2><ul>' FROM it
UNION ALL SELECT DISTINCT domain, 2, CAST(NULL AS BIGINT), '</ul></body></html>' FROM it
""")
def digest(spark: SparkSession, sf: str) -> DataFrame:
    """S10 over the J4 changes, one digest per domain (positional image list empty)."""
    from ..functions import urls as U
    from ..operators.digest import update_digest
    ch = change_diff(spark, sf).withColumn("domain", U.netloc("url")).withColumn("image_cid", F.lit(None).cast("string"))
    return update_digest(ch, "domain", "row_id")


@register("error_digest", f"""
WITH robots AS ({ORACLE_ROBOTS_FILTER}),
e AS (SELECT p.page_id, p.url FROM pages p JOIN robots r USING (page_id) WHERE NOT r.allowed),
q AS (SELECT page_id, url, CASE WHEN contains(url, '''') AND NOT contains(url, '"') THEN '"' || replace(url, '\\', '\\\\') || '"'
                                ELSE '''' || replace(replace(url, '\\', '\\\\'), '''', '\\''') || '''' END AS u FROM e),
it AS (SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain, page_id,
              '<li>' || replace(replace(replace(replace(replace('[' || u || ', ''Full scan returned None'']',
                '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</li>' AS line FROM q)
SELECT domain, 1 AS section, CAST(page_id AS BIGINT) AS pos, line FROM it
UNION ALL SELECT DISTINCT domain, 0, CAST(NULL AS BIGINT), '<h1>Web Checker Error Report</h1>' || chr(10) || '<ul>' FROM it
UNION ALL SELECT DISTINCT domain, 2, CAST(NULL AS BIGINT), '</ul>' FROM it
""")
def error_digest(spark: SparkSession, sf: str) -> DataFrame:
    """S12 + S11: pages the robots rules block fail their full scan; one error digest per domain."""
    from ..functions import urls as U
    from ..operators.digest import error_digest as digest_errors
    pages = table(spark, sf, "pages").select("page_id", "url")
    blocked = robots_filter(spark, sf).filter(~F.col("allowed")).join(pages, "page_id")
    errs = blocked.select("page_id", "url", F.lit("Full scan returned None").alias("message"),
                          U.netloc("url").alias("domain"))
    return digest_errors(errs, "domain", "page_id")
