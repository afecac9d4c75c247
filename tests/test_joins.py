"""URL joining and robots files, with inputs of our own."""

from urllib.parse import urljoin

import pytest

from pagewise.functions import urls as U
from pagewise.operators import robots

BASES = ["http://h/a/b/c/d/e/f/g.html", "https://host.org/x/", "http://h", "http://h/a?u=/p/../q#z"]
LINKS = ["../../../../../x", "..", ".", "../", "./y", "/../x", "/a/./b/../c", "z?u=/p/../q", "../../../../../../../../../t#a/../b",
         "//other/a/../b", "http://o/a/../b", "?q=1", "#f", "", "/a//b", "m/n/../../o/."]


def test_join_as_the_standard_one(spark):
    rows = [(b, l) for b in BASES for l in LINKS]
    df = spark.createDataFrame(rows, "b string, l string")
    got = [r.u for r in df.select(U.resolve("b", "l").alias("u")).collect()]
    wrong = [(b, l, g, urljoin(b, l)) for (b, l), g in zip(rows, got) if g != urljoin(b, l)]
    assert not wrong, wrong


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_robots_lines(spark, end):
    text = end.join(["# ours", "User-agent: other", "Disallow: /", "", "User-agent:\t*", "Allow:\t/closed/open", "Disallow:\t/closed\t", "Disallow:"])
    files = spark.createDataFrame([("h", text)], "host string, robots_txt string")
    paths = ["/closed/x", "/closed/open/1", "/free", "/closed"]
    pages = spark.createDataFrame([(i, "h", f"http://h{p}") for i, p in enumerate(paths)], "page_id long, host string, url string")
    got = {r.page_id: r.allowed for r in robots.allowed(pages, files).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False}
