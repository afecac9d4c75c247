"""Text digests built from ranked rows (S10 update digest, S11 error digest, P28 prompt).

S10 and S11 give the lines of a digest as rows with a total order (``section``, ``pos``), however many there
are: no task gathers a digest, and a sink that writes them in that order gives the document.  P28 is one row
per group from an ordered ``collect_list``, bounded by its top-n list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Update-digest wording (heading, link text, missing-screenshot note).
DIGEST_HEADING = "更新ページ一覧"
DIGEST_LINK_TEXT = "リンクを開く"
DIGEST_NO_IMAGE = "(スクリーンショット取得失敗)"
# Error-digest heading.
ERROR_HEADING = "Web Checker Error Report"


def _lines(items: DataFrame, group: str, pos: str, item: Column, head: str, tail: str) -> DataFrame:
    """``group, section, pos, line``: the heading (section 0), the items (1) in ``pos`` order, the closing (2).
    A group without items has no lines."""
    body = items.select(group, F.lit(1).alias("section"), F.col(pos).cast("long").alias("pos"), item.alias("line"))
    ends = F.array(F.struct(F.lit(0).alias("section"), F.lit(head).alias("line")),
                   F.struct(F.lit(2).alias("section"), F.lit(tail).alias("line")))
    frame = (items.select(group).distinct().select(group, F.explode(ends).alias("e"))
                  .select(group, "e.section", F.lit(None).cast("long").alias("pos"), "e.line"))
    return body.unionByName(frame)


def answer_prompt(docs: DataFrame, group: str, rank: str, head: str, mid: str, tail: str) -> DataFrame:
    """Numbered source blocks (score 4 decimals, credibility 2) inside the
    answer template, one prompt per group.  ``docs`` needs query, title, href,
    final_score, credibility_score, body and the rank column."""
    block = F.concat(
        F.lit("--- Information Source "), (F.col(rank) + 1).cast("string"), F.lit(" ---\n"),
        F.lit("Title: "), F.coalesce(F.col("title"), F.lit("N/A")), F.lit("\n"),
        F.lit("URL: "), F.coalesce(F.col("href"), F.lit("N/A")), F.lit("\n"),
        F.lit("Final Score: "), T.py_fixed("final_score", 4),
        F.lit(" (Credibility: "), T.py_fixed("credibility_score", 2), F.lit(")\n"),
        F.lit("Extracted Content:\n"), F.coalesce(F.col("body"), F.lit("No content extracted.")), F.lit("\n\n"))
    # one aggregate gives the query as well: the ranking behind ``docs`` is worked out once
    parts = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("o"), F.col("_block").alias("p"))))
    found = (docs.where(F.col(group).isNotNull()).withColumn("_block", block)
             .groupBy(group).agg(F.first("query").alias("_q"), parts.alias("_parts")))
    body = F.array_join(F.transform("_parts", lambda s: s["p"]), "")
    return found.select(group, F.concat(F.lit(head), F.col("_q"), F.lit(mid), body, F.lit(tail)).alias("prompt"))


def update_digest(changes: DataFrame, group: str, pos: str, url: str = "url",
                  image: str = "image_cid") -> DataFrame:
    """HTML list of changed URLs, each with its screenshot reference or a
    placeholder, in ``pos`` order; lines join without a separator."""
    item = F.concat(
        F.lit("<li><p>\""), F.col(url), F.lit("\"</p><a href=\""), F.col(url),
        F.lit(f"\" target=\"_blank\">{DIGEST_LINK_TEXT}</a><br>"),
        F.when(F.col(image).isNotNull(),
               F.concat(F.lit("<img src=\"cid:"), F.col(image), F.lit("\" style=\"max-width:500px;\">")))
         .otherwise(F.lit(f"<p>{DIGEST_NO_IMAGE}</p>")),
        F.lit("</li>"))
    return _lines(changes, group, pos, item, f"<html><body><h2>{DIGEST_HEADING}</h2><ul>", "</ul></body></html>")


def error_digest(errors: DataFrame, group: str, pos: str, url: str = "url", message: str = "message") -> DataFrame:
    """Every error as the list ``[url, message]`` printed and HTML-escaped; lines join by newline."""
    item = F.concat(F.lit("<li>"), T.html_escape(T.py_list_repr(F.array(F.col(url), F.col(message)))), F.lit("</li>"))
    return _lines(errors, group, pos, item, f"<h1>{ERROR_HEADING}</h1>\n<ul>", "</ul>")


def write_document(lines: DataFrame, path: str, sep: str) -> None:
    """Write the lines of one digest so that its part files, read in the order of their names, are the document: dealt
    out by range of (``section``, ``pos``) and sorted.  ``sep`` stands between lines; every line ends in ``>``, which the
    writer puts there itself as the end of a record, so that nothing else is added."""
    ordered = lines.repartitionByRange("section", "pos").sortWithinPartitions("section", "pos")
    start = F.when(F.col("section") == 0, F.lit("")).otherwise(F.lit(sep))
    body = F.concat(start, F.expr("substr(line, 1, length(line) - 1)"))
    ordered.select(body.alias("value")).write.mode("overwrite").option("lineSep", ">").text(path)
