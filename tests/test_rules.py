"""Pagination, robots files, dates and the monitoring comparison, with inputs of our own."""

import pytest
from pyspark.sql import functions as F

from pagewise.functions import times as D
from pagewise.operators import pagination as PG
from pagewise.operators import robots as RB

SHOP = "https://shop.example/list"


@pytest.mark.parametrize("base,links,next_url,kind", [
    (f"{SHOP}/page=7", [f"{SHOP}/page=9", f"{SHOP}/page=30", f"{SHOP}/page=8"], f"{SHOP}/page=30", "page_changer"),
    (f"{SHOP}/page=31", [f"{SHOP}/page=30", f"{SHOP}/page=4"], None, "page_changer"),          # only smaller numbers
    (f"{SHOP}/page4", ["page5?sort=up", "/list/page5"], f"{SHOP}/page5?sort=up", "page_changer"),  # a tie: the first
    (f"{SHOP}/page4", ["page04", "imprint"], None, "page_changer"),
    (f"{SHOP}/offers", [f"{SHOP}/page=2"], None, "plane"),                                      # no number to go on from
    (f"{SHOP}/page-2", None, None, "page_changer"),
    (f"{SHOP}/page-2", ["Page-3", "page_3"], None, "page_changer"),                             # neither is a numbered link
])
def test_pagination(spark, base, links, next_url, kind):
    df = spark.createDataFrame([(base, links)], "u string, l array<string>")
    r = df.select(PG.next_url("u", "l").alias("n"), PG.web_type("u").alias("t")).first()
    assert (r.n, r.t) == (next_url, kind)


def test_update_check_needs_numbered_links(spark):
    rows = [(f"{SHOP}/page-2", ["page-3"]), (f"{SHOP}/page-2", ["page3", "page/3"]), (f"{SHOP}/x", ["page-3"]), (f"{SHOP}/page-2", None)]
    df = spark.createDataFrame(rows, "u string, l array<string>")
    assert [r[0] for r in df.select(PG.should_check_update("u", "l")).collect()] == [True, False, False, False]


def test_type_of_higher_priority_stays(spark):
    rank = {"plane": 1, "page_changer": 2, "not_quickscan": 3}
    rows = [(a, f"WebType.{b}") for a in rank for b in rank] + [("page_changer", None), ("plane", "what is this"), ("x", "not_quickscan")]
    df = spark.createDataFrame(rows, "c string, p string")
    got = [r[0] for r in df.select(PG.merge_web_type("c", "p")).collect()]
    assert got[:9] == [max(a, b, key=rank.get) for a in rank for b in rank]
    assert got[9:] == ["page_changer", "plane", "not_quickscan"]


def _chain(spark, pages, starts, **more):
    table = spark.createDataFrame(pages, "url string, next_url string, allowed boolean")
    asked = spark.createDataFrame([(u,) for u in starts], "url string")
    return {r.url: (r.final_url, r.hops, r.chain_ok) for r in PG.follow_chain(asked, table, **more).collect()}


def test_chain_of_pages(spark):
    pages = [(f"n{i}", f"n{i + 1}", True) for i in range(5)] + [("n5", None, True), ("lone", None, True), ("gap", "nowhere", True),
             ("before", "shut", True), ("shut", "n0", False), ("loop", "loop2", True), ("loop2", "loop", True), (None, "n0", True)]
    got = _chain(spark, pages, ["n0", "n3", "n5", "lone", "gap", "before", "shut", "loop", "unknown"])
    assert got == {"n0": ("n3", 3, True), "n3": ("n5", 2, True), "n5": ("n5", 0, True), "lone": ("lone", 0, True),
                   "gap": ("nowhere", 1, False), "before": ("shut", 1, False), "shut": ("shut", 0, False),
                   "loop": ("loop2", 3, True), "unknown": ("unknown", 0, False)}
    assert _chain(spark, pages, ["n0"], max_hops=1) == {"n0": ("n1", 1, True)}
    assert _chain(spark, pages, []) == {}


def test_chain_joins_no_null_url(spark):
    """Requests without a next URL leave after the first look; no further hop is planned for them."""
    got = _chain(spark, [("a", None, True), ("b", None, None)], ["a", "b"])
    assert got == {"a": ("a", 0, True), "b": ("b", 0, True)}


@pytest.mark.parametrize("robots,cases", [
    ("User-agent: *\nDisallow: /cart\nAllow: /cart/help", {"/cart/help": False, "/car": True, "/cart": False}),   # file order
    ("User-agent: *\nAllow: /cart/help\nDisallow: /cart", {"/cart/help/1": True, "/cart/2": False}),
    ("User-agent: crawler-x\nDisallow: /\n\nUser-agent: y\nUser-agent: *\nDisallow: /z", {"/a": True, "/z9": False}),
    ("User-agent: *\nDisallow: /one\nUser-agent: *\nDisallow: /two", {"/one": False, "/two": True}),              # the first group
    ("Disallow: /lost\nUser-agent: *\nCrawl-delay: 5\nDisallow: /kept # why", {"/lost": True, "/kept": False}),
    ("User-agent: *\nDisallow:\nDisallow: /never", {"/never": True}),
    (None, {"/any": True, "": True}),
    ("user-AGENT : *\nDISALLOW : /", {"/": False, "": False}),
])
def test_robots(spark, robots, cases):
    pages = spark.createDataFrame([(i, "h", "https://h" + p) for i, p in enumerate(cases)], "page_id long, host string, url string")
    files = spark.createDataFrame([("h", robots)], "host string, robots_txt string")
    got = {r.page_id: r.allowed for r in RB.allowed(pages, files).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


DATES = {   # text: (wall or UTC time, without an offset)
    "1999-12-31T23:59:58Z": ("1999-12-31 23:59:58.000000", False), "1999-12-31T23:59:58-01:30": ("2000-01-01 01:29:58.000000", False),
    "1999-12-31 23:59": ("1999-12-31 23:59:00.000000", True), "19991231": ("1999-12-31 00:00:00.000000", True),
    "19991231 2359": ("1999-12-31 23:59:00.000000", True), "19991231T235958,25": ("1999-12-31 23:59:58.250000", True),
    "1999-12-31T23": ("1999-12-31 23:00:00.000000", True), "1999-12-31T23+05": ("1999-12-31 18:00:00.000000", False),
    "1999-12-31T23:59:58.0000019+0000": ("1999-12-31 23:59:58.000001", False), "2000-02-29": ("2000-02-29 00:00:00.000000", True),
    "19991231 23:59:58": ("1999-12-31 23:59:58.000000", True),
    "1999/12/31 23:59": ("1999-12-31 23:59:00.000000", False), "12/31/1999": ("1999-12-31 00:00:00.000000", False),
    "1999/12/31": ("1999-12-31 00:00:00.000000", False), "31-12-1999": ("1999-12-31 00:00:00.000000", False),
    "23:59:58": ("1900-01-01 23:59:58.000000", False), "23:59": ("1900-01-01 23:59:00.000000", False),
}
NO_DATES = ["", None, "soon", "1999-02-29", "31/12/1999", "1999-12-31T24:01", "1999-1-1", "1999-12-31\n", "@1999", "1999-12-31T23:59:58+0",
            "1999-1231", "23:60", "1999-12-31T2359:58"]


def test_dates(spark):
    rows = [(t,) for t in [*DATES, *NO_DATES]]
    out = spark.createDataFrame(rows, "s string").select("s", D.parse_datetime("s").alias("p"))
    got = {r.s: (r.t, r.n) for r in out.select("s", F.date_format("p.ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"), F.col("p.naive").alias("n")).collect()}
    assert {t: got[t] for t in DATES} == DATES
    assert {t: got[t] for t in NO_DATES} == dict.fromkeys(NO_DATES, ("1970-01-01 00:00:00.000000", False))


def test_age(spark):
    now = F.lit("2021-06-10 06:00:00").cast("timestamp")
    rows = ["2021-06-03T05:59:59Z", "2021-06-03T06:00:01Z", "2021-06-10T07:00:00Z", "2021-06-03", "", None, "never"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "s string").select(D.age_days("s", now)).collect()]
    assert got == [7, 6, -1, 99, 99, 99, 18788]


def test_scan_decision_is_compiled(spark):
    """The age of a row and what follows from it stay small enough for a filter on them to be compiled."""
    from pagewise.plans.monitoring import scan_decision
    from pagewise.sources.watchlist import normalize
    rows = [(0, "u0", ["p"], "2021-06-09T00:00:00Z", "plane"), (1, "u1", ["p"], "2021-06-09T00:00:00Z", "page_changer"),
            (2, "u2", ["p"], "2021-06-01T00:00:00Z", "plane"), (3, "u3", [], "2021-06-09T00:00:00Z", "plane"), (4, "u4", ["p"], "2021-06-09", "plane")]
    watch = normalize(spark.createDataFrame(rows, "row_id long, url string, css_selector_list array<string>, full_scan_datetime string, web_page_type string"))
    out = scan_decision(watch, F.lit("2021-06-10 06:00:00").cast("timestamp"))
    assert {r.row_id: r.scan_mode for r in out.collect()} == {0: "quick", 1: "quick_full", 2: "full", 3: "full", 4: "full"}
    quick = out.filter("scan_mode = 'quick'")
    assert [r.row_id for r in quick.collect()] == [0]
    assert len(quick._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_changes_and_image_names(spark):
    from pagewise.plans.monitoring import changes, set_image_names
    schema = "row_id long, url string, result_vl string"
    before = spark.createDataFrame([(5, "k", "same"), (6, "l", "old"), (7, "m", None), (8, "n", None), (9, "o", "gone")], schema)
    after = spark.createDataFrame([(5, "k", "same"), (6, "l/moved", "new"), (7, "m", "first"), (8, "n", None), (9, "o", None)], schema)
    assert sorted((r.row_id, r.url) for r in changes(before, after).collect()) == [(6, "l/moved"), (7, "m"), (9, "o")]
    images = spark.createDataFrame([("m", "/shots/2021/m.png")], "url string, image_path string")
    named = set_image_names(after.withColumn("image_filename", F.lit("kept.png")), images)
    assert {r.row_id: r.image_filename for r in named.collect()} == {5: "kept.png", 6: "kept.png", 7: "m.png", 8: "kept.png", 9: "kept.png"}
