"""C2 with pagination, C3 quick scan, C4 scan decision + state update, C5 run.

Inputs are tables: the watch list, the page snapshots ``pages(page_id, url,
html)`` (one snapshot per url) and the node tables derived from them.  Page
analysis (main content, selectors, links) is computed once per page and shared
by every watch row that needs it; per-row logic is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import times as D
from ..functions import urls as U
from ..operators import digest as DG
from ..operators import dom as DOM
from ..operators import pagination as PG
from ..operators import robots as RB
from ..operators import selectors as SEL
from ..operators.rank import positions
from ..session import cut_lineage
from ..sources import watchlist as WL
from . import full_scan as FS

QUICK_SCAN_MAX_AGE_DAYS = 4
MAX_PAGE_HOPS = 3
NO_QUICK_TYPES = ("page_changer", "not_quickscan")


def page_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Links of the whole tree (root = body), sorted absolute hrefs."""
    roots = (nodes.filter(F.col("parent_id").isNull() & (F.col("tag") != "#text"))
                  .select("page_id", F.col("node_id").alias("root_id"),
                          (F.col("node_id") + F.col("subtree_size") - 1).alias("root_end")))
    return DOM.subtree_links(nodes, roots, pages).select("page_id", F.col("links").alias("page_links"))


def page_analysis(pages: DataFrame, nodes: DataFrame, prepared: DataFrame, checkpoint: bool = True,
                  robots: DataFrame | None = None) -> DataFrame:
    """Per page: main-content result (C2 body), the page's own type and next URL (A9), and whether ``robots``
    (``host, robots_txt``) lets it be scanned (J11, F5; all pages without it).

    One row per page, read by every scan path of the run (quick-full, full, the
    pagination hops), so it is written once to the checkpoint folder."""
    mc = FS.main_content(pages, prepared, nodes).drop("web_type")
    mc = cut_lineage(mc) if checkpoint else mc          # two short plans, not one of both: the driver holds a plan whole
    pl = page_links(nodes, pages)
    base = pages.select("page_id", "url").join(pl, "page_id", "left")
    base = with_robots(base.withColumn("next_url", PG.next_url("url", "page_links")), robots)
    out = base.join(mc.drop("url"), "page_id", "left")
    return cut_lineage(out) if checkpoint else out


def with_robots(pages: DataFrame, robots: DataFrame | None) -> DataFrame:
    """``allowed`` per page: the robots file of its host against its path."""
    if robots is None:
        return pages.withColumn("allowed", F.lit(True))
    return RB.allowed(pages.withColumn("host", U.netloc("url")), robots, "host").drop("host")


def full_scan(requests: DataFrame, analysis: DataFrame, previous_type: Column | None = None,
              max_hops: int = MAX_PAGE_HOPS) -> DataFrame:
    """C2 per request row (``row_id, url`` + optional previous page type): follow the page's next URL up to
    ``max_hops`` times (J5), take the final page's main content, merge the page type (P16).

    The robots gate stands before every page, the hops' as well: a page that is blocked, or missing from the
    snapshots, gives a null result (``found`` false)."""
    prev_col = previous_type if previous_type is not None else F.lit(None).cast("string")
    r = requests.withColumn("_prev", prev_col)
    chain = PG.follow_chain(r.select("row_id", "url"), analysis, max_hops=max_hops)
    res_cols = ["node_id", "tag", "css_selector", "css_selector_list", "text", "links", "score", "rect"]
    res = analysis.select(F.col("url").alias("final_url"), *res_cols)
    ok = chain.where("chain_ok").select("row_id", "final_url", "hops").join(res, "final_url")
    out = r.join(ok, "row_id", "left")
    first_type = F.when(F.col("hops") > 0, PG.web_type("url"))
    prev = F.coalesce(F.nullif(F.col("_prev"), F.lit("")), first_type)
    cur_type = PG.web_type("final_url")
    wt = F.when(prev.isNull(), cur_type).otherwise(PG.merge_web_type(cur_type, prev))
    found = F.col("node_id").isNotNull()
    return (out.withColumn("found", found)
               .withColumn("result_url", F.when(found, F.col("final_url")))
               .withColumn("result_web_type", F.when(found, wt))
               .drop("final_url", "hops", "_prev"))


def quick_scan(watch: DataFrame, pages: DataFrame, nodes: DataFrame, prepared: DataFrame) -> DataFrame:
    """C3 direct path: the first selector of the stored list that matches a node of
    the page (list order, then document order); T9 moves it to the front.
    Rows of type page_changer/not_quickscan or without selectors are not handled
    here (they go to the full scan)."""
    w = (watch.filter(~PG.web_type_from_string("web_page_type").isin(*NO_QUICK_TYPES)
                      & (F.size("css_selector_list") > 0))
              .join(pages.select("page_id", "url"), "url"))
    m = SEL.first_match(w.select("row_id", "page_id", "css_selector_list"), prepared)
    # found once: the text, the links and the result read it
    m = cut_lineage(m.select("row_id", "page_id", "node_id", "subtree_end", "tag", F.col("selector").alias("q_selector")))
    roots = m.select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end")).distinct()
    txt = DOM.subtree_text(nodes, roots)
    lnk = DOM.subtree_links(nodes, roots, pages)
    out = (m.join(txt.withColumnRenamed("root_id", "node_id"), ["page_id", "node_id"], "left")
            .join(lnk.withColumnRenamed("root_id", "node_id"), ["page_id", "node_id"], "left")
            .join(w.select("row_id", "url", "css_selector_list", "web_page_type"), "row_id"))
    return out.select("row_id", "node_id", "tag", F.col("q_selector").alias("css_selector"),
                      SEL.move_to_front("css_selector_list", "q_selector").alias("css_selector_list"),
                      F.coalesce("text", F.lit("")).alias("text"), "links",
                      F.col("web_page_type").alias("result_web_type"), F.col("url").alias("result_url"))


def scan_decision(watch: DataFrame, now: Column) -> DataFrame:
    """F7 + P8: age of the last full scan and the quick-scan eligibility per row."""
    age = D.age_days("full_scan_datetime", now)
    eligible = (F.size("css_selector_list") > 0) & (age < QUICK_SCAN_MAX_AGE_DAYS) & (F.col("web_page_type") != "")
    direct = eligible & ~PG.web_type_from_string("web_page_type").isin(*NO_QUICK_TYPES)
    return (watch.withColumn("scan_age_days", age)
                 .withColumn("quick_eligible", eligible)
                 .withColumn("scan_mode", F.when(direct, "quick").when(eligible, "quick_full").otherwise("full")))


# The error texts of a scan.
EMPTY_RESULT, NO_RESULT = "Empty result page detected", "Full scan returned None"
TIME_LIMIT_S = 60


def update_state(watch: DataFrame, pages: DataFrame, nodes: DataFrame, prepared: DataFrame, now: Column,
                 analysis: DataFrame | None = None, robots: DataFrame | None = None, empty: DataFrame | None = None,
                 durations: DataFrame | None = None, limit_s: int = TIME_LIMIT_S) -> tuple[DataFrame, DataFrame]:
    """C4 for every row: returns ``(new_watch, errors)``.

    Quick scan when eligible; a page_changer/not_quickscan row is analysed in full inside the quick call with a plane
    previous type and no new full-scan stamp; otherwise, or when the quick scan finds nothing, a full scan with the
    stored type.  The row is rewritten when the stored type is empty or the link fingerprint changed; a quick match
    always keeps the reordered selector list.

    Errors (S12: ``row_id, url, message``): a full scan without result, and a result page that ``empty(url)`` names
    as empty, clear the selectors and the full-scan time (``result_vl`` untouched) and end the row's work; rows that
    were worked to the end and took longer than ``limit_s`` by ``durations(row_id, duration_s)`` are told as well.
    """
    if analysis is None:
        analysis = page_analysis(pages, nodes, prepared, robots=robots)
    skipped = watch.filter(F.col("url").isNull() | (F.col("url") == ""))      # F9
    watch = watch.filter(F.col("url").isNotNull() & (F.col("url") != ""))
    d = cut_lineage(scan_decision(watch, now))
    q = quick_scan(d.filter(F.col("scan_mode") == "quick"), pages, nodes, prepared)
    qcols = ["css_selector_list", "links", "result_web_type", "result_url"]
    q = cut_lineage(q.select("row_id", *[F.col(c).alias("q_" + c) for c in qcols]))
    d = cut_lineage(d.join(q, "row_id", "left")
                     .withColumn("quick_hit", F.col("q_result_url").isNotNull()))

    # one full scan for all rows that the quick scan did not settle
    requests = d.filter(~F.col("quick_hit")).select("row_id", "url", "web_page_type", "scan_mode")
    in_quick = F.col("scan_mode") == "quick_full"
    fs = full_scan(requests, analysis, previous_type=F.when(in_quick, F.lit("plane")).otherwise(F.col("web_page_type")))
    # worked out once: the new watch list and the errors read it
    d = cut_lineage(d.join(fs.select("row_id", "found", *[F.col(c).alias("f_" + c) for c in qcols]), "row_id", "left"))
    scanned = F.coalesce(F.col("found"), F.lit(False))

    def pick(name):
        return F.when(F.col("quick_hit"), F.col("q_" + name)).when(scanned, F.col("f_" + name))

    d = d.select("*", pick("links").alias("_links"), pick("css_selector_list").alias("_list"),
                 pick("result_web_type").alias("_type"), pick("result_url").alias("_url"))
    if empty is not None:
        marked = empty.select(F.col("url").alias("_url")).distinct().withColumn("_empty", F.lit(True))
        d = d.join(marked, "_url", "left")
    else:
        d = d.withColumn("_empty", F.lit(False))
    if durations is not None:
        d = d.join(durations.select("row_id", F.col("duration_s").alias("_took")), "row_id", "left")
    else:
        d = d.withColumn("_took", F.lit(None).cast("double"))

    none = F.col("_url").isNull()
    is_empty = ~none & F.coalesce(F.col("_empty"), F.lit(False))
    new_hash = TX.link_fingerprint("_links")
    d = d.select("*", none.alias("_none"), is_empty.alias("_is_empty"), (none | is_empty).alias("_failed"), new_hash.alias("_hash"))
    failed = F.col("_failed")
    changed = ~failed & ((F.col("web_page_type") == "") | (F.col("result_vl") != F.col("_hash")))
    now_s = D.iso_utc_string(now)
    stamped = ~F.col("quick_hit") & (F.col("scan_mode") != "quick_full")
    out = d.select(
        "row_id", F.when(changed, F.col("_url")).otherwise(F.col("url")).alias("url"), "run_code",
        F.when(changed, F.col("_hash")).otherwise(F.col("result_vl")).alias("result_vl"),
        F.when(changed, now_s).otherwise(F.col("updated_datetime")).alias("updated_datetime"),
        F.when(failed, F.lit("")).when(stamped, now_s).otherwise(F.col("full_scan_datetime")).alias("full_scan_datetime"),
        F.when(failed, F.array().cast("array<string>")).when(changed | F.col("quick_hit"), F.col("_list"))
         .otherwise(F.col("css_selector_list")).alias("css_selector_list"),
        F.when(changed, F.col("_type")).otherwise(F.col("web_page_type")).alias("web_page_type"), "image_filename")
    ended = (F.when(F.col("_none"), F.lit(NO_RESULT)).when(F.col("_is_empty"), F.lit(EMPTY_RESULT)))
    early = d.where(failed).select("row_id", "url", ended.alias("message"))
    late = d.where(~failed & (F.col("_took") > limit_s)).select(
        "row_id", "url", F.concat(F.lit(f"Processing time exceeded {limit_s} sec -> "), TX.py_fixed("_took", 2), F.lit(" sec")).alias("message"))
    errors = early.unionByName(late) if durations is not None else early
    return out.unionByName(skipped.select(*out.columns)), errors


def zip_positional(urls: DataFrame, images: DataFrame) -> DataFrame:
    """Pair changed URLs with their screenshots by position (full outer on ``pos``);
    a missing image gets no id (the digest shows the placeholder)."""
    return urls.join(images, "pos", "full")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """J4 ``chk_diff``: rows whose ``result_vl`` differs (null-safe), by row id; emits the new URL."""
    b = before.select("row_id", F.col("result_vl").alias("_old"))
    a = after.select("row_id", "url", "result_vl")
    return a.join(b, "row_id").filter(~F.col("_old").eqNullSafe(F.col("result_vl"))).select("row_id", "url")


def set_image_names(watch: DataFrame, images: DataFrame, order: str | None = None) -> DataFrame:
    """Every row with the url gets the base name of its image path: of several, the last by the column
    ``order``, or the largest path when none is named."""
    im = images.groupBy("url").agg(F.max_by("image_path", order or "image_path").alias("_img"))
    return (watch.join(im, "url", "left")
                 .withColumn("image_filename", F.coalesce(U.base_name("_img"), F.col("image_filename")))
                 .drop("_img"))


def monitoring_run(watch: DataFrame, pages: DataFrame, now: Column, nodes: DataFrame | None = None,
                   prepared: DataFrame | None = None, analysis: DataFrame | None = None, robots: DataFrame | None = None,
                   empty: DataFrame | None = None, durations: DataFrame | None = None):
    """C4 for every row, then J4: returns ``(new_watch, changed_rows, errors)``; the run code is on every row."""
    if prepared is None:
        nodes, prepared = FS.prepare(pages, nodes)
    new, errors = update_state(watch, pages, nodes, prepared, now, analysis, robots, empty, durations)
    new, errors = cut_lineage(new.withColumn("run_code", D.iso_utc_string(now))), cut_lineage(errors)
    return new, changes(watch, new), errors


def monitor(spark: SparkSession, watch_path: str, pages: DataFrame, now: Column, out: str, images: DataFrame | None = None,
            **scan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C5 from file to file: the watch list at ``watch_path`` (S1) is scanned (C4) and compared (J4), the changed rows take
    the images of their positions (``images(pos, image_path, image_cid)``: J9, J10), and three documents are written
    below ``out``: ``watch`` (S3), ``update`` (S10) and ``errors`` (S11; both absent when they would have no item).
    Returns the new watch list, the changed rows with their image ids, and the errors."""
    watch = cut_lineage(WL.read_json(spark, watch_path))
    new, changed, errors = monitoring_run(watch, pages, now, **scan)
    changed = cut_lineage(positions(changed, ["row_id"], "pos"))
    if images is not None:
        pairs = zip_positional(changed, images.select("pos", "image_path", "image_cid")).where("url is not null")
        new = cut_lineage(set_image_names(new, pairs.where("image_path is not null"), "pos"))
        changed = cut_lineage(pairs)
    else:
        changed = changed.withColumn("image_cid", F.lit(None).cast("string"))
    WL.write_json(new, f"{out}/watch")
    for name, lines, sep in (("update", DG.update_digest(changed.withColumn("run", F.lit(0)), "run", "pos"), ""),
                             ("errors", DG.error_digest(errors.withColumn("run", F.lit(0)), "run", "row_id"), "\n")):
        if not lines.isEmpty():
            DG.write_document(lines, f"{out}/{name}", sep)
    return new, changed, errors
