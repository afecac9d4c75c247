"""Trees of our own: main content against a walk of each tree, parsing, result containers, no-results."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pagewise.functions import dom_scores as DS
from pagewise.operators import dom as DOM
from pagewise.operators import quality as Q
from pagewise.plans import full_scan as FS
from pagewise.sources.html_nodes import html_to_nodes, parse_html

RECT = "struct<x:double,y:double,width:double,height:double>"
PREP_SCHEMA = (f"page_id long, node_id int, parent_id int, subtree_end int, depth int, tag string, id string, "
               f"attributes map<string,string>, css_selector string, rect {RECT}, n_links int, text_len int, "
               f"n_words int, page_w double, page_h double")


TAGS = ["div", "section", "ul", "li", "p", "nav", "main", "span", "header", "article", "h2"]


def _tree(rnd, page, n):
    """A random tree in document order with boxes of its own: ``n`` elements below a body, some without a box."""
    parent, depth = [None], [0]
    for i in range(1, n):
        at = i - 1
        while at and rnd.random() < 0.45:
            at = parent[at]
        parent.append(at)
        depth.append(depth[at] + 1)
    end = list(range(n))
    for i in range(n - 1, 0, -1):
        end[parent[i]] = max(end[parent[i]], end[i])
    rows = []
    for i in range(n):
        box = tuple(float(rnd.randrange(0, 900)) for _ in range(4)) if rnd.random() < 0.93 else None
        tag, name = ("body" if not i else rnd.choice(TAGS)), rnd.choice(["", "", "", "main-1", f"n{i}"])
        selector = f"{tag}#{name}" if name else tag if rnd.random() < 0.9 else ""
        rows.append((page, i, parent[i], end[i], depth[i], tag, name, {"id": name} if name else {}, selector, box, rnd.randrange(0, 15),
                     rnd.choice([0, 5, 40, 300, 2500]), 0, 1200.0, 800.0))
    return rows


def _density(box, w, h, links, text, profile):
    """The base score of a box against a reference box, worked out by the standard library."""
    x, y, bw, bh = box or (0, 0, 0, 0)
    share = bw * bh / (w * h if w * h > 0 else 1)
    score = math.exp(-((share - profile.occupancy_peak) / profile.occupancy_sigma) ** 2 / 2)
    xn, wn = ((x + bw / 2) / w, bw / w) if box and w > 0 else (0, 0)
    yn, hn = (y / h, bh / h) if box and h > 0 else (0, 0)
    score *= statistics.NormalDist(0.5, 0.35).pdf(xn) * statistics.NormalDist(0.5, 0.35).pdf(yn) * min(hn, 0.9) ** 1.5
    score *= wn ** 5.7 * math.exp(-wn / 0.11) / (math.gamma(6.7) * 0.11 ** 6.7) if wn > 0 else 0
    if profile.legacy_links:
        return score * 0.2 * min(links, 5)
    link = math.exp(-((links - 6) / (5 if links <= 6 else 30)) ** 2 / 2) if links else 0.1
    words = math.exp(-((text - 50) / (40 if text <= 50 else 1000)) ** 2 / 2) ** 1.5 if text else 0
    return score * link * words


def _brute_main_content(rows, profile):
    """Candidates, refinement and selectors of one page, node by node: (candidates, winner, moves, selectors)."""
    by = {r[1]: r for r in rows}
    scores = {}
    for r in rows:
        box = r[9]
        if r[5].upper() not in profile.invalid_tags and (box[2] * box[3] if box else 0) >= 0.05:
            bonus = 0.5 if r[5] == "main" or "main" in r[7].get("id", "") else 0
            scores[r[1]] = _density(box, 1200, 800, r[10], r[11], profile) + bonus
    if not scores:
        return {}, None
    best = min(scores, key=lambda i: (-scores[i], by[i][4], i))
    moves, listed = 0, []
    while moves < profile.max_moves:
        root = by[best]
        w, h = root[9][2:] if root[9] else (0, 0)
        listed = []
        for i in range(best, root[3] + 1):
            r, d = by[i], by[i][4] - root[4]
            s = _density(r[9], w, h, r[10], r[11], profile) * 4 ** (d / profile.depth_max)
            listed += [(-s, g, i) for g in range(d + 1 if profile.repeat_rescored else 1)]
        listed.sort()
        own = next(-s for s, _, i in listed if i == best)
        if -listed[0][0] <= own:
            break
        best, moves = listed[0][2], moves + 1
    return scores, (best, moves, [by[i][8] for _, _, i in listed[1:4] if by[i][8]])


@pytest.mark.parametrize("profile", [DS.CURRENT], ids=lambda p: p.name)
def test_main_content_against_a_walk_of_each_tree(spark, profile):
    rnd = random.Random(11)
    trees = {page: _tree(rnd, page, rnd.choice([1, 2, 9, 60, 150])) for page in range(40)}
    prepared = spark.createDataFrame([r for t in trees.values() for r in t], PREP_SCHEMA)
    pages = spark.createDataFrame([(p, f"http://e.example/{p}") for p in trees], "page_id long, url string")
    got = {}
    for r in FS.candidates(prepared, profile).collect():
        got.setdefault(r.page_id, {})[r.node_id] = r.cand_score
    main = {r.page_id: r for r in FS.main_content(pages, prepared, profile=profile).collect()}
    moved = 0
    for page, rows in trees.items():
        scores, end = _brute_main_content(rows, profile)
        assert got.get(page, {}) == pytest.approx(scores)
        if end is None:
            assert page not in main
            continue
        node, moves, selectors = end
        own = rows[node][8]
        assert (main[page].node_id, main[page].moves) == (node, moves)
        assert main[page].css_selector_list == ([own] if own and own not in selectors else []) + selectors
        moved += moves > 0
    assert moved >= 5


def test_preorder_parse():
    html = "<body><ul><li>one<li><em>two</em><br></ul><!-- no --><table><tr><td>3</table><hr></body>"
    tags = [n[3] for n in parse_html(html) if n[3] != "#text"]
    assert tags == ["body", "ul", "li", "li", "em", "br", "table", "tbody", "tr", "td", "hr"] or tags == [
        "body", "ul", "li", "li", "em", "br", "table", "tr", "td", "hr"]


def test_implied_closes():
    nodes = parse_html("<body><p><b>X<br><p>Y</p><ul><li>1<li>2</ul></body>")
    tags = [(n[3], n[0]) for n in nodes]
    # the second <p> closes the first; the never-closed <b> is re-opened before each later text,
    # as browsers do; the second <li> closes the first
    assert [t for t, _ in tags if t != "#text"] == ["body", "p", "b", "br", "p", "b", "ul", "li", "b", "li", "b"]


def test_refinement_moves_to_better_child_and_stops(spark):
    pages = spark.createDataFrame([(1, "http://ex.com/a",
        "<body><nav><a href='/1'>one</a></nav><div class='w'><article><p>" + "word " * 12 +
        "<a href='/x'>x</a></p></article></div></body>")], "page_id long, url string, html string")
    nodes, prep = FS.prepare(pages, cut=False)
    st = FS.refine(prep, FS.top_candidate(FS.candidates(prep)), checkpoint=False).first()
    assert st.done or st.moves == DS.CURRENT.max_moves
    mc = FS.main_content(pages, prep, nodes, checkpoint=False).first()
    assert mc.css_selector_list[0] == mc.css_selector        # own selector first
    assert mc.text.strip() != ""


def _page(spark, body):
    pages = spark.createDataFrame([(1, "http://find.example/?q=1", f"<body>{body}</body>")], "page_id long, url string, html string")
    nodes, prep = FS.prepare(pages, cut=False)
    return pages, nodes, prep, prep.filter("id = 'found'").select("page_id", "node_id", "subtree_end")


TEN = "eins zwei drei vier fünf sechs sieben acht neun"
CARDS = "".join(f"<li class='card'><a href='/{i}'>zehn</a> {TEN}</li>" for i in range(4))


@pytest.mark.parametrize("body,score,items", [
    (f"<ol id='found' class='k'>{CARDS}<li class='more'>x</li></ol>", 16 / 5, 4),
    (f"<div id='found'><p>a</p><ol>{CARDS}</ol><ul><li class='z'>1</li><li class='z'>2</li></ul></div>", 4.0, 4),
    (f"<div id='found'><ul><li class='z'>1</li><li class='z'>2</li></ul><ol><li class='y'>{TEN} zehn</li><li class='y'><a href=''>n</a> {TEN}</li></ol></div>", 2.0, 0),
    ("<div id='found'><p class='a b'>1</p><p class='b a'>2</p><p>3</p><p>4</p></div>", None, 0),   # no class value twice, none is none
    ("<div id='found'><p class='a'>1</p></div>", None, 0),
    (f"<div id='found'>x</div><ol>{CARDS}</ol>", None, 0),                                          # outside the main content
])
def test_result_container_and_items(spark, body, score, items):
    pages, nodes, prep, main = _page(spark, body)
    found = Q.result_container(prep, main).collect()
    assert [r.container_score for r in found] == ([] if score is None else [pytest.approx(score)])
    q = Q.quantify(Q.result_items(prep, Q.result_container(prep, main)), main).first()
    assert q.result_count == items == len(q.result_item_ids)
    assert q.result_item_ids == sorted(q.result_item_ids)


@pytest.mark.parametrize("text,more,result", [
    ("Sadly, NOTHING found here", "<ul class='search-results'></ul>", True),            # the text speaks first
    ("すみません、検索結果がありません。", "", True),
    ("twelve hits", "<p class='x empty-state'>-</p><ul class='search-results'></ul>", True),   # then a selector for none
    ("twelve hits", "<i data-qa='no-results-found'></i>", True),
    ("twelve hits", "<b data-qa='else'></b><ul id='search-results-container'></ul>", False),   # then one for some
    ("twelve hits", "<ul class='a results-list'></ul>", False),
    ("twelve hits", "<ul id='results-list'></ul>", True),                                # neither: by default none
])
def test_no_results(spark, text, more, result):
    pages, nodes, prep, _ = _page(spark, f"<div id='found'><p>{text}</p></div>{more}")
    root = prep.filter("id = 'found'").select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
    main = DOM.subtree_text(nodes, root).withColumnRenamed("root_id", "node_id")
    assert Q.no_results(main, prep, pages).first().is_no_results is result


def test_subtree_text_and_links(spark):
    pages = spark.createDataFrame([(7, "http://ex.com/d/p.html",
                                    "<body><div><a href='b'>B</a> mid <a href='/a'>A</a></div></body>")],
                                  "page_id long, url string, html string")
    nodes = html_to_nodes(pages)
    roots = nodes.filter("tag = 'div'").select("page_id", F.col("node_id").alias("root_id"),
                                               (F.col("node_id") + F.col("subtree_size") - 1).alias("root_end"))
    t = DOM.subtree_text(nodes, roots).first().text
    links = DOM.subtree_links(nodes, roots, pages).first().links
    assert t == "B mid A"
    assert links == ["http://ex.com/a", "http://ex.com/d/b"]


def test_search_and_validate(spark):
    from pagewise.plans.page_quality import search_and_validate
    res_html = ("<body><div class='g'><a href='http://t.com/a'>A</a></div><div class='g'><a href='/rel'>r</a>"
                "<a href='http://t.com/b'>B</a><a href='http://t.com/a'>A again</a></div></body>")
    results = spark.createDataFrame([(1, "http://search.com/q", res_html)], "page_id long, url string, html string")
    rnodes, _ = FS.prepare(results, cut=False)
    target = ("<body><main><p>python " + "word " * 20 + "</p></main></body>")
    pages = spark.createDataFrame([(10, "http://t.com/a", target)], "page_id long, url string, html string")
    out = {r.url: r.label for r in search_and_validate(results, rnodes, pages, "python").collect()}
    assert set(out) == {"http://t.com/a", "http://t.com/b"}
    assert out["http://t.com/b"] == "no content" and out["http://t.com/a"] == "EMPTY"


def test_nodes_stay_where_they_are_stored(spark):
    """A refinement pass and a subtree read join the bucketed nodes without an exchange or sort of them."""
    pages = spark.createDataFrame([(i, f"http://e.example/{i}", "<body>" + "<div><p>some words <a href='/x'>x</a></p></div>" * 5 + "</body>") for i in range(30)],
                                  "page_id long, url string, html string")
    nodes, prep = FS.prepare(pages)
    start = FS.top_candidate(FS.candidates(prep))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        roots = start.select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
        plan = DOM.in_subtree(nodes.select("page_id", "node_id", "text"), roots)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(page_id") == 0, plan
        assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    state = FS.refine(prep, start)
    assert state.count() == 30 and state.select("page_id").distinct().count() == 30


def test_the_driver_plans_and_holds_no_more_by_the_pass(spark):
    """Whoever reads a refinement plans one table, not every pass's, and no pass sends its state through the driver."""
    pages = spark.createDataFrame([(i, f"http://e.example/{i}", "<body>" + "<div><main><p>some words <a href='/x'>x</a></p></main></div>" * 5 + "</body>")
                                   for i in range(20)], "page_id long, url string, html string")
    nodes, prep = FS.prepare(pages)
    main = FS.main_content(pages, prep, nodes, profile=DS.LEGACY)
    plan = main._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan, plan
    assert main.count() == 20
    passes = FS.refine(prep, FS.top_candidate(FS.candidates(prep)), checkpoint=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in passes and "Broadcast" not in passes, passes


def test_a_run_works_out_its_parts_once(spark):
    """The selectors of a quick scan are matched once, and a run's watch list and errors are read from one scan of its rows."""
    from pagewise.plans import monitoring as MON
    from pagewise.sources.watchlist import normalize
    pages = spark.createDataFrame([(i, f"http://e.example/{i}", f"<body><main><p>some words {i} <a href='/x'>x</a></p></main></body>") for i in range(6)],
                                  "page_id long, url string, html string")
    nodes, prep = FS.prepare(pages)
    watch = normalize(pages.select(F.col("page_id").alias("row_id"), "url", F.lit("2024-02-28T00:00:00Z").alias("full_scan_datetime"),
                                   F.lit("plane").alias("web_page_type"), F.array(F.lit("main")).alias("css_selector_list")))
    q = MON.quick_scan(watch, pages, nodes, prep)
    assert "Generate" not in q._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.row_id, r.tag, r.text) for r in q.collect()} == {(i, "main", f"some words {i} x") for i in range(6)}
    missing = normalize(spark.createDataFrame([(9, "http://e.example/none")], "row_id long, url string")).select(*watch.columns)
    new, errors = MON.update_state(watch.unionByName(missing), pages, nodes, prep, F.lit("2024-02-29 00:00:00").cast("timestamp"))
    for part in (new, errors):
        assert "Join" not in part._jdf.queryExecution().optimizedPlan().toString()
    assert new.count() == 7 and [(r.row_id, r.message) for r in errors.collect()] == [(9, MON.NO_RESULT)]


def test_nodes_are_handed_on_in_small_pieces():
    """However many pages Spark puts into one batch, a worker holds the node rows of about ``html_bytes`` of HTML."""
    import pyarrow as pa

    from pagewise.sources.html_nodes import _html_to_nodes
    html = "<body>" + "<p class=c>some words</p>" * 50 + "</body>"
    batch = pa.RecordBatch.from_arrays([pa.array([*range(40), None]), pa.array([html] * 40 + [None])], names=["page_id", "html"])
    pieces = list(_html_to_nodes([batch], html_bytes=2 * len(html), rows=150))
    assert max(p.num_rows for p in pieces) <= 202 and len(pieces) >= 20
    rows = [r for p in pieces for r in p.to_pylist()]
    assert len(rows) == 40 * 101 and [r["node_id"] for r in rows[:101]] == list(range(101))
    assert rows[1] | {"attributes": dict(rows[1]["attributes"])} == {
        "page_id": 0, "node_id": 1, "parent_id": 0, "depth": 2, "child_idx": 0, "subtree_size": 2, "tag": "p", "id": "", "class": "c",
        "attributes": {"class": "c"}, "text": None, "href": None}
