"""The stream against C5 batch by batch, its keyed state, and a restart; legacy choice content; snapshot read-back."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewise.operators import dom as DOM
from pagewise.operators import legacy as L
from pagewise.operators import snapshots as SN
from pagewise.plans import full_scan as FS
from pagewise.plans import monitoring as MON
from pagewise.sources.watchlist import normalize
from pagewise.streaming import changes as X2
from pagewise.streaming.state import KeyedTable

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


PAGE = "page_id long, url string, html string"


def _html(name, *links):
    body = "".join(f"<p>{name} has these words and more of them <a href='/{x}'>to {x}</a></p>" for x in links)
    return f"<html><body><nav><a href='/home'>home</a></nav><main><h1>{name}</h1>{body}</main></body></html>"


#: Three deliveries: b changes in the second, c comes in the second, a changes in the third, which also brings b as it was.
BATCHES = [
    [(1, "http://s.example/a", _html("a", "x", "y")), (2, "http://s.example/b", _html("b", "x"))],
    [(3, "http://s.example/a", _html("a", "x", "y")), (4, "http://s.example/b", _html("b", "z", "x")), (5, "http://s.example/c", _html("c"))],
    [(6, "http://s.example/a", _html("a", "y")), (7, "http://s.example/b", _html("b", "z", "x")), (8, "http://s.example/a", _html("a", "w", "y")),
     (9, "http://s.example/t/page-1", _html("t1", "t/page-2")), (10, "http://s.example/t/page-2", _html("t2", "q"))],
]
CHANGED = [{"a", "b"}, {"b", "c"}, {"a", "t/page-1", "t/page-2"}]


def _deliver(spark, path, rows):
    import time
    time.sleep(1.1)                               # the stream takes files in modification-time order
    spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(path)


def _by_c5(spark, batches):
    """C5 over one watch list that the caller keeps: the changed rows of each batch."""
    state, out = {}, []
    for rows in batches:
        last = {u: (i, u, h) for i, u, h in sorted(rows)}
        known = [(i, *(state.get(u, (u, "", "", "", [], "")))) for i, u, _ in last.values()]
        watch = normalize(spark.createDataFrame(known, "row_id long, url string, result_vl string, updated_datetime string, full_scan_datetime string, "
                                                       "css_selector_list array<string>, web_page_type string"))
        pages = spark.createDataFrame(list(last.values()), PAGE)
        new, changed, _ = MON.monitoring_run(watch, pages, now())
        old_url = {r.row_id: r.url for r in watch.collect()}
        after = {r.row_id: r for r in new.collect()}
        out.append({(old_url[r.row_id], after[r.row_id].url, after[r.row_id].result_vl) for r in changed.collect()})
        for i, r in sorted(after.items()):
            if r.url != old_url[i]:
                state.pop(old_url[i], None)
            state[r.url] = (r.url, r.result_vl, r.updated_datetime, r.full_scan_datetime, r.css_selector_list, r.web_page_type)
    return out, state


@pytest.mark.parametrize("compact_every", [2, 50])
def test_stream_is_c5_batch_by_batch_and_after_a_restart(spark, tmp_path, compact_every):
    source, base = str(tmp_path / "in"), str(tmp_path / "x2")
    spark.createDataFrame(BATCHES[0], PAGE).coalesce(1).write.parquet(source)
    _deliver(spark, source, BATCHES[1])
    start = dict(now=now(), max_files_per_trigger=1, file_glob="*.parquet", base=base, compact_every=compact_every)
    q, root = X2.start(spark, source, **start)
    q.awaitTermination()
    _deliver(spark, source, BATCHES[2])
    q, _ = X2.start(spark, source, **start)           # a new query on the same folder goes on with batch 2
    q.awaitTermination()
    got = [set(), set(), set()]
    for r in X2.read_changes(spark, root).collect():
        got[r.batch_id].add((r.url, r.new_url, r.result_vl))
    want, state = _by_c5(spark, BATCHES)
    assert got == want
    assert [{u.removeprefix("http://s.example/") for u, _, _ in g} for g in got] == CHANGED
    kept = {r.url: r for r in X2.ChangeDetector(spark, base).state.everything(3).collect()}
    assert {u: (r.url, r.result_vl, r.updated_datetime, r.full_scan_datetime, r.css_selector_list, r.web_page_type) for u, r in kept.items()} == state
    assert "http://s.example/t/page-1" not in kept      # the row moved to the newest page


def test_batch_run_again_writes_the_same(spark, tmp_path):
    sink = X2.ChangeDetector(spark, str(tmp_path / "x2"), now())
    frames = [spark.createDataFrame(rows, PAGE) for rows in BATCHES[:2]]
    sink(frames[0], 0)
    sink(frames[1], 1)
    first = sorted(map(tuple, X2.read_changes(spark, sink.base).collect()))
    sink(frames[1], 1)
    assert sorted(map(tuple, X2.read_changes(spark, sink.base).collect())) == first
    assert {r.url for r in spark.read.parquet(f"{sink.base}/state/delta/batch=1").collect()} == {"http://s.example/b", "http://s.example/c"}


def test_stream_with_robots_and_errors(spark, tmp_path):
    robots = spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /b")], "host string, robots_txt string")
    sink = X2.ChangeDetector(spark, str(tmp_path / "x2"), now(), robots)
    sink(spark.createDataFrame(BATCHES[0], PAGE), 0)
    assert {r.url for r in X2.read_changes(spark, sink.base).collect()} == {"http://s.example/a"}
    errors = spark.read.parquet(f"{sink.base}/errors").collect()
    assert [(r.url, r.message) for r in errors] == [("http://s.example/b", "Full scan returned None")]


STATE = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "kt"), STATE, "k", buckets=4, compact_every=2)

    def put(batch, rows, gone=()):
        table.put(spark.createDataFrame(rows, STATE), spark.createDataFrame([(g,) for g in gone], "k string"), batch)

    def at(before, *keys):
        return {r.k: r.v for r in table.lookup(spark.createDataFrame([(k,) for k in keys], "k string"), before).collect()}
    assert at(0, "a", "b") == {}
    put(0, [("a", 1), ("b", 1), ("c", 1)])
    put(1, [("b", 2)], ["c", "b"])                      # set wins over removed
    put(2, [("d", 3)], ["a"])
    assert at(1, "a", "b", "c", "d") == {"a": 1, "b": 1, "c": 1}
    assert at(2, "a", "b", "c") == {"a": 1, "b": 2}
    assert at(3, "a", "b", "c", "d") == {"b": 2, "d": 3}
    put(2, [("d", 4)], ["b"])                           # the batch once more
    assert {r.k: r.v for r in table.everything(3).collect()} == {"a": 1, "d": 4}
    assert table._base(3) == 1 and table._base(1) == -1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        at(5, "a")                                      # batch 3 was never written: no state is made up


def test_choice_content(spark):
    pages = spark.createDataFrame([(1, "http://e.com/", "<body><div id='a'><div id='a'><p>x</p></div></div>"
                                    "<section><div id='a'>y</div></section></body>")], PAGE)
    nodes, prep = FS.prepare(pages, cut=False)
    got = L.choice_content(prep, tag="div", id_="a")
    rows = got.select("node_id", "selector").collect()
    # the div under <section> is cut off with its failing parent
    assert len(rows) == 2 and {r.selector for r in rows} == {"div#a"}


SNAPSHOT = "<body><section id='s' class='k l'><p>one <b>two</b> three</p><ul><li><a href='x?a=\"1\"'>é \\ \"q\"</a></li><li></li></ul></section><i>no</i></body>"


def _nested(rows, parent, texts, links):
    """The records below ``parent``, built by hand from node rows."""
    return [{"tag": r.tag, "id": r.id or "", "attributes": dict(r.attributes or {}), "children": _nested(rows, r.node_id, texts, links),
             "rect": r.rect.asDict(), "depth": r.depth, "text": texts.get(r.node_id, ""), "score": 0.5 if r.tag == "section" else 0.0,
             "css_selector": r.css_selector, "css_selector_list": ["section#s"] if r.tag == "section" else [], "links": links.get(r.node_id, []),
             "chk_url": "", "web_type": "plane" if r.tag == "section" else "", "result_count": 0, "result_items": [], "relevance_score": 0.0,
             "avg_relevance": 0.0, "relevance_variance": 0.0, "max_relevance": 0.0, "sqs_score": 0.0, "quality_category": "", "is_empty_result": False}
            for r in rows if r.parent_id == parent]


def test_nested_documents_there_and_back(spark):
    pages = spark.createDataFrame([(1, "http://e.com/d/", SNAPSHOT), (2, "http://e.com/", "<body><section id='s'></section></body>")], PAGE)
    nodes, prep = FS.prepare(pages)
    roots = prep.where("tag = 'section'").select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
    values = roots.select("page_id", F.col("root_id").alias("node_id"), F.lit(0.5).alias("score"), F.array(F.lit("section#s")).alias("css_selector_list"),
                          F.lit("plane").alias("web_type"))
    items = (prep.where("tag = 'li'").join(roots.select("page_id", F.col("root_id").alias("of_root")), "page_id")
             .select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"), "of_root"))
    docs = SN.documents(nodes, prep, roots, pages, values, items).cache()
    got = {r.page_id: json.loads(r.json) for r in docs.collect()}
    assert list(got[1]) == list(SN.FIELDS) and len(SN.FIELDS) == 22
    for page in (1, 2):
        rows = prep.where(f"page_id = {page}").orderBy("node_id").collect()
        every = prep.where(f"page_id = {page}").select("page_id", F.col("node_id").alias("root_id"), F.col("subtree_end").alias("root_end"))
        texts = {r.root_id: r.text for r in DOM.subtree_text(nodes, every).collect()}
        links = {r.root_id: r.links for r in DOM.subtree_links(nodes, every, pages).collect()}
        body = next(r for r in rows if r.parent_id is None)
        want = next(d for d in _nested(rows, body.node_id, texts, links) if d["tag"] == "section")
        shown = got[page].pop("result_items")
        assert [d["tag"] for d in shown] == (["li", "li"] if page == 1 else [])
        assert all(d in want["children"][1]["children"] for d in shown)
        got[page]["result_items"] = []
        assert got[page] == want
    back = SN.read_documents(docs).where("page_id = 1").orderBy("node_id").collect()
    assert [(r.tag, r.parent_id, r.subtree_size) for r in back] == [("section", None, 7), ("p", 0, 2), ("b", 1, 1), ("ul", 0, 4), ("li", 3, 2), ("a", 4, 1), ("li", 3, 1)]
    assert back[0].score == 0.5 and back[0].css_selector_list == ["section#s"] and back[0].attributes == {"id": "s", "class": "k l"}
    assert back[5].text == 'é \\ "q"' and back[5].rect.width > 0 and json.loads(back[0].result_items)[0]["tag"] == "li"
    assert sum(r.subtree_size for r in back if r.parent_id is None) == len(back)
    again = SN.read_documents(spark.createDataFrame([(9, None), (8, "{}")], "page_id long, json string"))
    assert again.count() == 0


def test_stream_query_reads_a_folder_of_files(spark, tmp_path):
    from pagewise.plans.catalog_dom import stream_changes
    rows = [(i, f"http://s.example/{i}", f'<html><body><article><p>words of {i}</p><a href="/{i}/x">more</a></article></body></html>') for i in range(4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.repartition(3).write.parquet(str(tmp_path / "folder" / "pages.parquet"))
    pages.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("part-*")).rename(tmp_path / "file" / "pages.parquet")
    for kind in ("folder", "file"):
        got = stream_changes(spark, str(tmp_path / kind)).collect()
        assert sorted((r.url, r.new_url, r.is_new) for r in got) == [(u, u, True) for _, u, _ in rows]
