"""Search operators against small brute-force checkers (own code)."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagewise.operators import relevance as R
from pagewise.operators import search as H
from pagewise.operators.rank import blocked_rank
from pagewise.plans.search import high_precision_search, search_with_cache


def bm25_brute(corpus, query, k1=1.5, b=0.75, eps=0.25):
    toks = [d.split(" ") for d in corpus]
    n = len(toks)
    avgdl = sum(len(t) for t in toks) / n
    df = {}
    for t in toks:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: (eps * mean if v < 0 else v) for w, v in idf.items()}
    out = []
    for t in toks:
        s = 0.0
        for q in query.split(" "):
            f = t.count(q)
            s += idf.get(q, 0) * (f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avgdl)))
        out.append(s)
    return out


def test_bm25_matches_brute_force(spark):
    rnd = random.Random(7)
    vocab = ["a", "b", "c", "d", "e", "f", "g", ""]
    corpus = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 12))) for _ in range(30)]
    query = "a c c zz e"
    items = spark.createDataFrame([("s", i, t) for i, t in enumerate(corpus)], "g string, k long, t string")
    queries = spark.createDataFrame([("s", query)], "g string, query string")
    got = {r.k: r.bm25_score for r in R.bm25_scores(items, queries, "g", "k", "t").collect()}
    exp = bm25_brute(corpus, query)
    assert [got[i] for i in range(len(corpus))] == pytest.approx(exp, abs=1e-9)


def test_rrf_and_final_ranking(spark):
    hits = spark.createDataFrame([("s", i, f"h{i}", f"h{i}", None, t) for i, t in
                                  enumerate(["x y", "x x x", "y", "z", "x"])],
                                 "search_id string, seq long, doc_key string, href string, title string, body string")
    q = spark.createDataFrame([("s", "x")], "search_id string, query string")
    res = high_precision_search(hits, q, lexical_top_n=3, semantic_top_n=4).orderBy("final_rank").collect()
    assert len(res) == 4
    bm = bm25_brute(["x y", "x x x", "y", "z", "x"], "x")
    lex = sorted(range(5), key=lambda i: (-round(bm[i], 9), i))[:3]
    fused = {i: 1 / (60 + i + 1) for i in range(5)}              # credibility list = original order
    for r, i in enumerate(lex):
        fused[i] += 2 / (60 + r + 1)                              # lexical + unchanged semantic list
    exp = sorted(range(5), key=lambda i: (-round(fused[i], 9), i))[:4]
    assert [r.seq for r in res] == exp
    assert [r.final_score for r in res] == pytest.approx([fused[i] for i in exp])


def test_blocked_rank(spark):
    rows = [("g", i, float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, seq long, c double")
    got = {r.seq: r.rank for r in blocked_rank(df, ["g"], "c", "seq", rows_per_block=7).collect()}
    exp = sorted(range(50), key=lambda i: (-(i % 3), i))
    assert [got[i] for i in exp] == list(range(50))
    sparse = spark.createDataFrame([("g", i * 7919 + 3, float(i % 2)) for i in range(40)], "g string, seq long, c double")
    got = {r.seq: r.rank for r in blocked_rank(sparse, ["g"], "c", "seq", rows_per_block=5).collect()}
    exp = sorted((i * 7919 + 3 for i in range(40)), key=lambda s: (-(((s - 3) // 7919) % 2), s))
    assert [got[s] for s in exp] == list(range(40))


def test_cache_lookup_brute_force(spark):
    rnd = random.Random(3)
    t0 = datetime(2024, 1, 1)
    sets = [(rnd.randint(0, 3), t0 + timedelta(seconds=rnd.randint(0, 20000))) for _ in range(60)]
    reqs = [(i, rnd.randint(0, 3), t0 + timedelta(seconds=rnd.randint(0, 20000))) for i in range(80)]
    c = spark.createDataFrame(sets, "k long, set_at timestamp")
    r = spark.createDataFrame(reqs, "rid long, k long, ts timestamp")
    got = {x.rid: (x.cache_hit, x.cache_set_at if x.cache_hit else None)
           for x in H.cache_lookup(r, c, "k", "ts", "set_at", ttl_s=3600).collect()}
    for rid, k, ts in reqs:
        cand = [s for kk, s in sets if kk == k and s <= ts]
        best = max(cand) if cand else None
        hit = best is not None and ts < best + timedelta(seconds=3600)
        assert got[rid] == (hit, best if hit else None)
    log = c.select("k", F.col("set_at").alias("ts"), F.lit(None).cast("long").alias("rid")).unionByName(r.select("k", "ts", "rid"))
    replay = H.cache_replay(log, "k", "ts", F.col("rid").isNull(), F.col("rid").isNotNull(), ttl_s=3600)
    assert {x.rid: (x.cache_hit, x.cache_set_at if x.cache_hit else None) for x in replay.collect()} == got
    assert replay.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_dedupe_last_value_first_position(spark):
    df = spark.createDataFrame([("u1", 0, "a"), ("u2", 1, "b"), ("u1", 2, "c")], "href string, seq long, title string")
    got = {r.href: (r.seq, r.title) for r in H.dedupe_hits(df, [], "href", "seq").collect()}
    assert got == {"u1": (0, "c"), "u2": (1, "b")}


def test_backend_fallback(spark):
    df = spark.createDataFrame([("q", 1, 1, "a"), ("q", 2, 1, "b"), ("q", 1, 3, "c"), ("r", 3, 1, "d")],
                               "q string, backend_priority int, pos int, href string")
    got = sorted(r.href for r in H.backend_fallback(df, max_results=2).collect())
    assert got == ["a", "d"]


def test_search_with_cache(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    queries = spark.createDataFrame([("s1", "python web")], "search_id string, query string")
    cache = spark.createDataFrame([("python web", datetime(2024, 1, 1, 11, 30), 1, "h1", "t", "python web stuff")],
                                  "cache_key string, set_at timestamp, pos int, href string, title string, body string")
    fresh = spark.createDataFrame([("best python web", 1, 1, "h2", "t", "web"), ("best python web", 2, 1, "h3", "t", "x"),
                                   ("python web best", 1, 1, "h1", "t2", "python web again")],
                                  "q string, backend_priority int, pos int, href string, title string, body string")
    res = search_with_cache(queries, cache, fresh, now).collect()
    assert {r.href for r in res} == {"h1", "h2"}
    assert [r.title for r in res if r.href == "h1"] == ["t2"]        # last value wins


def test_relevance_stats(spark):
    df = spark.createDataFrame([("p", 0.5), ("p", 0.7), ("q", 0.1)], "g string, relevance_score double")
    got = {r.g: r for r in R.relevance_stats(df, "g").collect()}
    assert got["p"].result_count == 2 and got["p"].relevance_variance == pytest.approx(0.01)
    assert got["p"].max_relevance == pytest.approx(0.7)


# ---- the inverted index -----------------------------------------------------------------------------------------

def _lists(rnd, size=60, words=25):
    """Result lists with common and rare words, equal and empty texts; searches that ask them, some for nothing."""
    vocabulary = [f"w{int(words * rnd.random() ** 3)}" for _ in range(400)] + ["Both", "both", "ÄÖ", "a", ""]
    items = [(c, 7 * i + 3, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40)))) for c in ("p", "q") for i in range(size)]
    items += [("p", 10_000, None), ("p", 10_001, ""), ("p", 10_002, items[0][2]), ("one", 1, "w1 w2 w3")]
    searches = [(i, rnd.choice(["p", "q"]), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 9)))) for i in range(14)]
    return items, [*searches, (90, "p", "nobody says this"), (91, "p", ""), (92, "one", "w1"), (93, "q", "w0 w0 w0 w1 w20 w24"), (94, "gone", "w1")]


def _index(spark, items, **more):
    from pagewise.operators import inverted as I
    df = spark.createDataFrame(items, "c string, d long, t string")
    return I.build_index(df, "c", "d", "t", "d", **more)


@pytest.mark.parametrize("seed,n,block", [(1, 10, 1 << 16), (2, 3, 8), (3, 200, 8)])
def test_bm25_by_bounds_is_bm25(spark, monkeypatch, seed, n, block):
    from pagewise.operators import inverted as I
    monkeypatch.setattr(I, "POSTINGS_PER_BLOCK", block)
    items, searches = _lists(random.Random(seed))
    queries = spark.createDataFrame(searches, "search long, corpus string, query string")
    got = {}
    for r in I.bm25_top(_index(spark, items, fields=("space",)), queries, n).orderBy("search", "rank").collect():
        got.setdefault(r.search, []).append((r.doc, round(r.bm25_score, 9)))
    for search, corpus, query in searches:
        own = [(d, t or "") for c, d, t in items if c == corpus]
        scores = bm25_brute([t for _, t in own], query) if own else []
        want = sorted(((d, round(s, 9)) for (d, _), s in zip(own, scores)), key=lambda x: (-x[1], x[0]))[:n]
        assert [d for d, _ in got.get(search, [])] == [d for d, _ in want], (search, query)
        assert [s for _, s in got.get(search, [])] == pytest.approx([s for _, s in want], abs=1e-8)


def test_index_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Scores are the same whether all, some or no terms are broadcast, with common words in blocks."""
    from pagewise import session
    from pagewise.operators import inverted as I
    monkeypatch.setattr(I, "POSTINGS_PER_BLOCK", 8)
    items, searches = _lists(random.Random(5))
    queries = spark.createDataFrame(searches, "search long, corpus string, query string")
    seen = []
    for room in (32 << 20, 2000, 0):
        monkeypatch.setattr(session, "BROADCAST_BYTES", room)
        index = _index(spark, items)
        rows = [(r.search, r.doc, round(r.jaccard_score, 9), round(r.tfidf_score, 9)) for r in I.relevance(index, queries).collect()]
        top = [(r.search, r.rank, r.doc, round(r.bm25_score, 9)) for r in I.bm25_top(index, queries, 10).collect()]
        seen.append((sorted(rows), sorted(top)))
    assert seen[0] == seen[1] == seen[2]


def test_index_keeps_postings_where_the_documents_are(spark):
    """Postings are not shuffled, and a document's score of a search is summed before the shuffle."""
    from pagewise.operators import inverted as I
    items, searches = _lists(random.Random(6))
    queries = spark.createDataFrame(searches, "search long, corpus string, query string")
    index = _index(spark, items)
    assert index.postings.columns == ["corpus", "doc", "field", "term", "tf", "len"]
    plan = I._matched(index, I.query_terms(index, queries))._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("tf#")]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in above, plan


def test_terms_of_a_text_are_counted_as_its_words():
    """Distinct tokens of given lists and of texts split at white space, in parts of a few bytes."""
    import pyarrow as pa
    from pagewise.operators import inverted as I
    given = [["a", "b", "a", ""], None, [], None, ["ß"]]
    texts = [None, "x\u2003y\x1cx\u00a0", None, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(given, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["doc", "tokens", "text"])
    for limit in (1, 1 << 20):
        got = [tuple(r.values()) for b in I._counted([batch], limit) for r in b.to_pylist()]
        assert sorted(got) == [(0, "", 1, 4), (0, "a", 2, 4), (0, "b", 1, 4), (1, "x", 2, 3), (1, "y", 1, 3), (4, "ß", 1, 1)]


def test_bounds_leave_common_words_out(spark):
    """A word that all documents have is not met by documents that no other word of the query has found."""
    from pagewise.operators import inverted as I
    items = [("c", i, "the " * 30 + ("rare words " if i % 50 == 0 else f"other{i} ")) for i in range(1000)]
    queries = spark.createDataFrame([(1, "c", "the rare words")], "search long, corpus string, query string")
    top = I.bm25_top(_index(spark, items, fields=("space",)), queries, 5)
    assert [r.doc for r in top.orderBy("rank").collect()] == [0, 50, 100, 150, 200]


def test_relevance_of_many_searches(spark):
    from pagewise.operators import inverted as I
    items, searches = _lists(random.Random(9))
    queries = spark.createDataFrame(searches, "search long, corpus string, query string")
    index = _index(spark, items)
    scored = I.relevance(index, queries)
    got = {(r.search, r.doc): r for r in scored.collect()}
    stats = {r.search: r for r in I.relevance_stats(index, queries, scored).collect()}
    assert 94 not in stats
    for search, corpus, query in searches:
        own = spark.createDataFrame([(corpus, d, t) for c, d, t in items if c == corpus] or [(corpus, 0, None)], "g string, k long, t string")
        if corpus == "gone":
            continue
        want = R.score_relevance(own, spark.createDataFrame([(corpus, query)], "g string, query string"), "g", "k", "t").collect()
        for w in want:
            g = got.get((search, w.k))
            assert ((g.jaccard_score, g.tfidf_score) if g else (0, 0)) == pytest.approx((w.jaccard_score, w.tfidf_score), abs=1e-9)
        values = [w.relevance_score for w in want]
        mean = sum(values) / len(values)
        s = stats[search]
        assert (s.result_count, s.avg_relevance, s.max_relevance) == (len(values), pytest.approx(mean), pytest.approx(max(values)))
        assert s.relevance_variance == pytest.approx(sum((v - mean) ** 2 for v in values) / len(values), abs=1e-12)


def _loader():
    return lambda pairs: [float(len(t)) if "x" in q else -float(len(t)) for q, t in pairs]


def test_model_orders_the_lexical_list(spark):
    from pagewise.operators import inverted as I
    from pagewise.plans.search import ranked_search
    items = [("c", i, "x " * (i + 1) + "y") for i in range(6)]
    docs = spark.createDataFrame([(c, d, d, f"h{d}", t, 0.0) for c, d, t in items], "corpus string, doc long, seq long, href string, body string, credibility_score double")
    queries = spark.createDataFrame([(1, "c", "x"), (2, "c", "y")], "search long, corpus string, query string")
    index = I.build_index(docs, "corpus", "doc", "body", "seq", ("space",))

    def order(**more):
        out = ranked_search(index, docs, queries, lexical_top_n=4, semantic_top_n=3, **more)
        return {s: [r.doc for r in out.where(f"search = {s}").orderBy("final_rank").collect()] for s in (1, 2)}, out
    plain, _ = order()
    ranked, out = order(model=_loader)
    assert plain != ranked
    for s, query in ((1, "x"), (2, "y")):
        brute = bm25_brute([t for _, _, t in items], query)
        lexical = sorted(range(6), key=lambda i: (-round(brute[i], 9), i))[:4]
        scores = _loader()([(query, items[i][2]) for i in lexical])
        semantic = [i for _, _, i in sorted((-v, k, i) for k, (v, i) in enumerate(zip(scores, lexical)))][:3]
        fused = dict.fromkeys(range(6), 0.0)
        for ranks in (lexical, semantic, range(6)):
            for k, i in enumerate(ranks):
                fused[i] += 1 / (61 + k)
        assert ranked[s] == sorted(fused, key=lambda i: (-round(fused[i], 9), i))[:3]
    scored = R.score_relevance(spark.createDataFrame([("g", 1, "ab")], "g string, k long, t string"), spark.createDataFrame([("g", "x")], "g string, query string"),
                               "g", "k", "t", model=_loader).first()
    assert scored.semantic_score == 2.0 and scored.relevance_score == pytest.approx(1.0)


def test_cosine_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 100)        # a few queries a block
    rnd = random.Random(4)
    vectors = [(i, [rnd.choice([-1.0, 0.0, 2.0, 0.5]) for _ in range(4)]) for i in range(40)] + [(90, [0.0] * 4), (91, None)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 6 = 0 or vec_id > 89").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    got = {}
    for r in R.embedding_cosine(df, asked, top_n=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.semantic_score, 9)))

    def cosine(a, b):
        length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / length if length else 0.0
    usable = {i: v for i, v in vectors if v is not None}
    for q in [i for i in usable if i % 6 == 0 or i > 89]:
        want = sorted(((i, round(cosine(usable[q], v), 9)) for i, v in usable.items()), key=lambda x: (-x[1], x[0]))[:7]
        assert got[q] == want
    assert 91 not in got and R.embedding_cosine(df, asked.limit(0)).count() == 0


def test_first_vectors_of_a_task():
    """A task's packs against a block of queries: the first of each query by the rounded score, then by key, in whatever pack."""
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(9)
    some = [[rnd.gauss(0, 1) for _ in range(5)] for _ in range(9)]
    vectors = [rnd.choice(some) if i % 2 else [rnd.gauss(0, 1) for _ in range(5)] for i in range(60)] + [[0.0] * 5]
    norms = [math.sqrt(sum(x * x for x in v)) for v in vectors]
    asked = vectors[::6]

    def arrow(rows):
        return pa.array(rows, pa.list_(pa.float64()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(61)), arrow(vectors), pa.array(norms)], names=["k", "v", "n"])
    packs = list(R._pack([rows], rows=16))
    assert [len(p.column("keys")[0]) for p in packs] == [16, 16, 16, 13]
    block = [pa.array([list(range(0, 61, 6))]), arrow([sum(asked, [])]), arrow([norms[::6]])]
    met = [pa.RecordBatch.from_arrays([*p.columns, *block], names=["keys", "flat", "norms", "q_keys", "q_flat", "q_norms"]) for p in packs]
    got = {}
    for r in (r for b in R._nearest(4, query_rows=3)(iter(met)) for r in b.to_pylist()):
        got.setdefault(r["query"], []).append((-round(r["score"], 9), r["key"]))
    for q in range(0, 61, 6):
        scores = [(float(np.dot(vectors[q], v)) / (norms[q] * n) if norms[q] * n else 0.0) for v, n in zip(vectors, norms)]
        assert sorted(got[q])[:4] == sorted((-round(s, 9), i) for i, s in enumerate(scores))[:4] and len(got[q]) < 30


def test_answer_prompt_reads_its_documents_once(spark):
    from pagewise.operators.digest import answer_prompt
    rows = [("a", "what?", i, f"http://x.example/{i}", 0.5 / (i + 1), 0.1, f"words {i}" if i else None) for i in range(3)]
    rows += [("b", "who?", 0, None, 0.25, 0.0, "more"), (None, "lost", 0, None, 0.25, 0.0, "none")]
    docs = spark.createDataFrame(rows[::-1], "search string, query string, rank int, href string, final_score double, credibility_score double, body string")
    # one row of ``docs`` gives one key to the accumulator each time that it is read
    read = spark.sparkContext.accumulator(0)
    rdd = docs.rdd.map(lambda r: (read.add(1), r)[1])
    prompts = answer_prompt(spark.createDataFrame(rdd, docs.schema).withColumn("title", F.lit(None).cast("string")), "search", "rank", "H:", "|", "T")
    got = {r.search: r.prompt for r in prompts.collect()}
    assert read.value == len(rows) and set(got) == {"a", "b"}

    def block(i, href, score, cred, body):
        return f"--- Information Source {i} ---\nTitle: N/A\nURL: {href}\nFinal Score: {score} (Credibility: {cred})\nExtracted Content:\n{body}\n\n"
    assert got["b"] == "H:who?|" + block(1, "N/A", "0.2500", "0.00", "more") + "T"
    assert got["a"] == "H:what?|" + "".join(block(i + 1, f"http://x.example/{i}", f"{0.5 / (i + 1):.4f}", "0.10", f"words {i}" if i else "No content extracted.")
                                            for i in range(3)) + "T"


# ---- metadata -----------------------------------------------------------------------------------------------------

HEADS = {
    "<meta name=\"author\" content=\"A. Writer\"><meta property=\"article:published_time\" content=\"2020-01-02\">": ("A. Writer", "2020-01-02"),
    "<META CONTENT='B &amp; &quot;C&quot;' data-x=1 NAME='author'>": ("B & \"C\"", None),
    "<meta content=2021 property=article:published_time name=other/>": (None, "2021"),
    "<!-- <meta name='author' content='hidden'> --><script>'<meta name=\"author\" content=\"no\">'</script>": (None, None),
    "<meta name='author' content=''><meta name='author' content='second'>": (None, None),
    "<meta name='authors' content='x'><meta property='author' content='y'><meta data-name='author' content='z'>": (None, None),
    "<meta name='author' content='a > b'>": ("a > b", None),
}


def test_metadata_behind_an_extractor(spark):
    from pagewise.plans.page_quality import process_content
    rows = [(i, f"https://h{i}.example.org/p", f"<html><head>{h}</head><body>x</body></html>") for i, h in enumerate(HEADS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    main = pages.select("page_id", F.lit("text").alias("text"))
    got = {r.page_id: r for r in process_content(pages, main).collect()}
    assert [(got[i].author, got[i].date) for i in range(len(rows))] == list(HEADS.values())
    assert got[0].credibility_score == pytest.approx((0.1 + 0.15 + 0.15 + 0.1) / 1.1) and got[3].credibility_score == pytest.approx(0.2 / 1.1)
    assert got[0].sitename == "h0.example.org"
    found = spark.createDataFrame([(0, "Extracted", "", None), (3, None, "1999", "Site")], "page_id long, author string, date string, sitename string")
    got = {r.page_id: r for r in process_content(pages, main, found).collect()}
    assert (got[0].author, got[0].date, got[0].sitename) == ("Extracted", "2020-01-02", "h0.example.org")
    assert (got[3].author, got[3].date, got[3].sitename) == (None, "1999", "Site")


def test_scores_of_whole_groups(spark):
    """A page's items scored in one task have the scores of the joins by term, also without texts, words or a query."""
    items = spark.createDataFrame([(1, 1, "a red Fox, the fox_1 \u2003 x"), (1, 2, None), (1, 3, "red red red"), (1, 4, "nothing shared"), (2, 1, "x"), (2, 2, "\u00c9t\u00e9 \u03a3\u03a3"),
                                   (3, 1, "no query"), (4, 1, "  "), (4, 2, "words 7\u00bd")], "page_id long, node_id int, text string")
    asked = spark.createDataFrame([(1, "the RED red fox"), (2, "\u00e9t\u00e9 \u03c3\u03c3"), (4, None), (5, "no items")], "page_id long, query string")
    columns = ["page_id", "node_id", "jaccard_score", "tfidf_score", "semantic_score", "relevance_score"]
    read = lambda whole: sorted(tuple(round(x, 9) for x in r) for r in R.score_relevance(
        items, asked, "page_id", "node_id", "text", whole_groups=whole).select(*columns).collect())
    assert read(True) == read(False) and len(read(True)) == 9
    assert R.score_relevance(items.where("false"), asked, "page_id", "node_id", "text", whole_groups=True).count() == 0


def test_page_quality_shuffles_no_terms(spark):
    """The items of a page stay in one task: no exchange of page_quality's relevance is by term."""
    items = spark.createDataFrame([(1, 1, "a b")], "page_id long, node_id int, text string")
    asked = spark.createDataFrame([(1, "a b")], "page_id long, query string")
    plan = R.score_relevance(items, asked, "page_id", "node_id", "text", whole_groups=True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(page_id" in plan and "term" not in plan
