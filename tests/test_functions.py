"""Values of the column functions against closed forms and the standard library, on inputs of our own."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from pagewise.functions import dom_scores as DS
from pagewise.functions import scores as S
from pagewise.functions import text as T
from pagewise.functions import urls as U
from pagewise.operators.dom import css_selector


def one(spark, expr, schema="x double", rows=None):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def _gauss(x, mean, sd):
    return math.exp(-((x - mean) ** 2) / (2 * sd * sd))


def test_occupancy_is_a_bell_around_its_peak(spark):
    rates = [None, -3.0, 0.05, 0.37, 0.62, 0.95, 2.0]
    got = one(spark, DS.occupancy_multiplier(F.col("x")), rows=[(r,) for r in rates])
    assert got == pytest.approx([_gauss(max(r or 0.0, 0.0), 0.8, 0.3) for r in rates])
    legacy = one(spark, DS.occupancy_multiplier(F.col("x"), 0.6, 0.3, False), rows=[(r,) for r in rates])
    assert legacy == pytest.approx([_gauss(r or 0.0, 0.6, 0.3) for r in rates])


def test_links_and_text(spark):
    counts = [None, 0, 1, 4, 7, 19, 61, 350]
    got = one(spark, DS.link_score(F.col("x")), "x int", [(n,) for n in counts])
    assert got == pytest.approx([_gauss(n, 6, 5 if n <= 6 else 30) if n else 0.1 for n in counts])
    got = one(spark, DS.text_score(F.col("x")), "x int", [(n,) for n in counts])
    assert got == pytest.approx([_gauss(n, 50, 40 if n <= 50 else 1000) ** 1.5 if n else 0.0 for n in counts])


def test_depth_grows_by_its_factor(spark):
    depths = [-4.0, 0.5, 1.0, 3.0, 10.0]
    got = one(spark, DS.depth_weight(F.col("x")), rows=[(d,) for d in depths])
    assert got == pytest.approx([4 ** (max(d, 0) / 5) for d in depths])
    got = one(spark, DS.depth_weight(F.col("x"), 7, clamp=False), rows=[(d,) for d in depths])
    assert got == pytest.approx([4 ** (d / 7) for d in depths])


def test_densities(spark):
    xs = [-0.2, 0.0, 0.01, 0.44, 0.7, 1.3]
    assert one(spark, DS.normal_pdf(F.col("x"), 0.3, 0.2), rows=[(x,) for x in xs]) == pytest.approx([statistics.NormalDist(0.3, 0.2).pdf(x) for x in xs])
    k, scale = 6.7, 0.11
    want = [x ** (k - 1) * math.exp(-x / scale) / (math.gamma(k) * scale ** k) if x > 0 else 0.0 for x in xs]
    assert one(spark, DS.gamma_pdf(F.col("x")), rows=[(x,) for x in xs]) == pytest.approx(want)


def test_main_element(spark):
    rows = {("Main", None): True, ("section", "page_main_1"): True, ("li", "doMAIN"): True, ("article", "body"): False, ("", "main"): False,
            (None, None): False, ("p", None): False, ("mainly", "x"): False}
    df = spark.createDataFrame([(t, {"id": i, "class": "main"} if i else {"class": "main"}) for t, i in rows], "tag string, attributes map<string,string>")
    assert [r[0] for r in df.select(DS.is_main_element()).collect()] == list(rows.values())


def test_valid_element(spark):
    rect = "struct<x:double,y:double,width:double,height:double>"
    rows = [("li", (5.0, 5.0, 0.5, 0.1)), ("li", (5.0, 5.0, 0.7, 0.07)), ("Menu", (0.0, 0.0, 9.0, 9.0)), ("h2", (0.0, 0.0, 9.0, 9.0)),
            ("", (0.0, 0.0, 9.0, 9.0)), ("section", (0.0, 0.0, 30.0, 0.0)), ("section", None)]
    df = spark.createDataFrame(rows, f"tag string, rect {rect}")
    assert [r[0] for r in df.select(DS.is_valid_element()).collect()] == [True, False, False, True, False, False, False]
    assert [r[0] for r in df.select(DS.is_valid_element(profile=DS.LEGACY)).collect()] == [True, False, False, False, False, False, False]


def test_css_selector(spark):
    rows = {("ul", "", "x-1\ty_2  z"): "ul.x-1.y_2.z", ("ul", "k", "x"): "ul#k", (None, "", "q"): ".q", ("em", None, " "): "em", ("", "", ""): ""}
    df = spark.createDataFrame(list(rows), "tag string, id string, class string")
    assert [r[0] for r in df.select(css_selector()).collect()] == list(rows.values())


def test_domain(spark):
    from urllib.parse import urlparse
    urls = ["https://user:pw@host.example:8443/x?y#z", "HTTP://UPPER.example", "//no.scheme/x", "mailto:someone@example.org", "https://", "file:///a/b"]
    got = one(spark, U.netloc("x"), "x string", [(u,) for u in urls])
    assert got == [urlparse(u).netloc if "://" in u else "" for u in urls]


def test_jaccard(spark):
    rows = [("Red red BLUE", "blue green"), ("same", "SAME same"), ("", "x"), (None, None), ("a\tb c", "c\u3000d")]
    df = spark.createDataFrame(rows, "a string, b string")

    def brute(a, b):
        a, b = ({w.lower() for w in (t or "").split()} for t in (a, b))
        return len(a & b) / len(a | b) if a | b else 0.0
    assert [r[0] for r in df.select(T.jaccard("a", "b")).collect()] == pytest.approx([brute(a, b) for a, b in rows])


def test_hybrid(spark):
    rows = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.5, 0.25, 0.125)]
    df = spark.createDataFrame(rows, "j double, t double, s double")
    assert [r[0] for r in df.select(S.hybrid("j", "t", "s")).collect()] == pytest.approx([0.2, 0.3, 0.5, 0.2375])


def test_sqs(spark):
    rows = [(None, 0.5, 0.0, 1.0), (7, 0.31, 0.02, 0.77), (2, 0.9, 0.0, 1.0), (25, 0.02, 0.9, 0.05), (1, 0.0, 0.9, 0.0), (1, 0.15, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "n int, a double, v double, m double").withColumn("s", S.sqs("n", "a", "v", "m"))
    want = [max(0.0, 100 * (0.2 * math.log(n + 1) + 0.4 * a - 0.2 * v + 0.2 * m)) if n else 0.0 for n, a, v, m in rows]
    out = df.select("s", S.sqs_category("n", F.col("s")).alias("c")).collect()
    assert [r.s for r in out] == pytest.approx(want)
    names = ["Invalid/Empty" if not n or s < 20 else "Low Quality" if s < 60 else "Valid" for (n, *_), s in zip(rows, want)]
    assert [r.c for r in out] == names and set(names) == {"Invalid/Empty", "Low Quality", "Valid"}


def test_filename(spark):
    import hashlib
    urls = {"https://www.shop.example:81/a/b.c?q=1#f": ("/a/b.c", "www_shop_example:81_b.c"), "http://x.example/": ("", "x_example_index"),
            "http://x.example/deep/er//": ("/deep/er", "x_example_er")}
    got = one(spark, U.screenshot_filename("x"), "x string", [(u,) for u in urls])
    assert got == [f"{head}_{hashlib.md5(path.encode()).hexdigest()[:8]}.png" for path, head in urls.values()]


def test_fingerprint_matches_python_repr(spark):
    import hashlib
    lists = [["a", "b"], [], ["it's", 'say "hi"', "both ' and \""], ["back\\slash"]]
    df = spark.createDataFrame([(x,) for x in lists], "l array<string>")
    got = [r[0] for r in df.select(T.link_fingerprint("l")).collect()]
    assert got == [hashlib.sha256(str(x).encode()).hexdigest() for x in lists]


def test_cache_key_and_variants(spark):
    df = spark.createDataFrame([("Best  Python web",)], "q string")
    assert df.select(T.cache_key("q")).first()[0] == "best python web"
    from pagewise.operators.search import query_variants
    v = df.select(query_variants(F.col("q"))).first()[0]
    assert len(v) == 15 and 'intitle:"Best  Python web"' in v
    v2 = df.select(query_variants(F.col("q"), False)).first()[0]
    assert len(v2) == 12


def test_resolve(spark):
    rows = [("http://a.com/b/c.html", "/x"), ("http://a.com/b/c.html", "d"), ("http://a.com/b/c.html", "../d"),
            ("https://a.com/b/", "//cdn.com/y"), ("http://a.com/b", "http://z.org/q"), ("http://a.com/b?x=1", "?y=2")]
    df = spark.createDataFrame(rows, "b string, l string")
    got = [r[0] for r in df.select(U.resolve("b", "l")).collect()]
    from urllib.parse import urljoin
    assert got == [urljoin(b, l) for b, l in rows]


def test_words_python_whitespace(spark):
    texts = ["a b　c \x1c d\te f", "  ", "x y"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r[0] for r in df.select(T.words("s")).collect()]
    assert got == [t.split() for t in texts]
