"""Watch-list file, image names and digests on small own rows."""

import glob
import json

import pytest
from pyspark.sql import functions as F


def test_watch_list_file(spark, tmp_path):
    from pagewise.plans.monitoring import changes
    from pagewise.sources.watchlist import read_json
    path = tmp_path / "watch.json"
    path.write_text('[\n {"url": "https://a.example/", "result_vl": "x", "css_selector_list": ["p", "div.m"]},\n'
                    ' {"url": "https://b.example/", "web_page_type": null}, {"url": "https://c.example/", "row_id": 9}\n]')
    watch = read_json(spark, str(path))
    rows = {r.row_id: r for r in watch.collect()}
    assert sorted(rows) == [0, 1, 9]
    assert rows[0].url == "https://a.example/" and rows[0].css_selector_list == ["p", "div.m"]
    assert rows[1].web_page_type == "" and rows[1].css_selector_list == []
    after = watch.withColumn("result_vl", F.when(F.col("row_id") == 1, "new").otherwise(F.col("result_vl")))
    assert [(r.row_id, r.url) for r in changes(watch, after).collect()] == [(1, "https://b.example/")]


def test_watch_list_absent_or_invalid(spark, tmp_path):
    from pagewise.sources.watchlist import WATCH_SCHEMA, read_json
    assert read_json(spark, str(tmp_path / "none.json")).count() == 0
    for i, text in enumerate(("", "[]", "no list", '{"url": "https://a.example/"}')):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        watch = read_json(spark, str(path))
        assert watch.count() == 0 and watch.columns == WATCH_SCHEMA.names


def test_last_image_by_order(spark):
    from pagewise.plans.monitoring import set_image_names
    watch = spark.createDataFrame([("u", "")], "url string, image_filename string")
    images = spark.createDataFrame([("u", "/i/z.png", 1), ("u", "/i/a.png", 2)], "url string, image_path string, pos int")
    assert set_image_names(watch, images, "pos").first().image_filename == "a.png"
    assert set_image_names(watch, images).first().image_filename == "z.png"


def _document(lines, sep):
    rows = sorted(lines.collect(), key=lambda r: (r.section, r.pos if r.pos is not None else -1))
    return sep.join(r.line for r in rows)


def test_digests_are_whole(spark):
    from pagewise.operators.digest import error_digest, update_digest
    errors = spark.createDataFrame([("d", 5000, "https://a.example/?x=1&y=<2>", "it's late"), ("d", 3, "u", "m")],
                                   "d string, pos long, url string, message string")
    got = _document(error_digest(errors, "d", "pos"), "\n")
    assert got == ("<h1>Web Checker Error Report</h1>\n<ul>\n<li>[&#x27;u&#x27;, &#x27;m&#x27;]</li>\n"
                   "<li>[&#x27;https://a.example/?x=1&amp;y=&lt;2&gt;&#x27;, &quot;it&#x27;s late&quot;]</li>\n</ul>")
    many = spark.range(2500).select(F.lit("d").alias("d"), F.col("id").alias("pos"), F.concat(F.lit("u"), "id").alias("url"),
                                    F.when(F.col("id") == 7, "img7").alias("image_cid"))
    page = _document(update_digest(many, "d", "pos"), "")
    assert page.count("<li>") == 2500 and page.count("<h2>") == 1 and page.count('src="cid:img7"') == 1
    assert page.index('"u999"') < page.index('"u1000"') and page.endswith("</ul></body></html>")
    assert update_digest(many.limit(0), "d", "pos").count() == 0


@pytest.fixture
def many_parts(spark):
    """Small tables are written in several part files too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _files(path):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_saved_watch_list_reads_back(spark, tmp_path, many_parts):
    """S3 -> S1: many records over several part files, and what a plain reader of the joined files sees."""
    from pagewise.sources.watchlist import WATCH_SCHEMA, normalize, read_json, write_json
    rows = [(i, f"https://w.example/{i}?q=\"{i}\"&x={{y}},[z]", "", None if i % 3 else "h\n,", "", "", ["p", "div.a[b='c']"] * (i % 2), "", "é漢") for i in range(500)]
    watch = normalize(spark.createDataFrame(rows[::-1], WATCH_SCHEMA)).repartition(5)
    path = str(tmp_path / "saved")
    write_json(watch, path)
    assert len(glob.glob(f"{path}/part-*")) > 1
    back = read_json(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, watch.collect()))
    document = json.loads(_files(path))
    assert [r["row_id"] for r in document] == list(range(500)) and document[7]["url"] == rows[7][1]
    write_json(watch.limit(0), path)
    assert read_json(spark, path).count() == 0 and json.loads(_files(path)) == []
    write_json(watch.where("row_id = 3"), path)
    assert [r.row_id for r in read_json(spark, path).collect()] == [3]


def test_legacy_csv_rows_have_their_positions(spark, tmp_path):
    from pagewise.sources.watchlist import read_legacy_csv
    path = tmp_path / "old.csv"
    path.write_text("".join(f"https://w.example/{i},c,r{i},,,{'div.x' if i % 2 else ''},{'0.0' if i % 5 else 'plane'}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = {r.row_id: r for r in read_legacy_csv(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows) == list(range(4000)) and all(r.url == f"https://w.example/{i}" for i, r in rows.items())
    assert rows[3].css_selector_list == ["div.x"] and rows[4].css_selector_list == []
    assert rows[5].web_page_type == "plane" and rows[6].web_page_type == ""


def test_documents_in_part_files(spark, tmp_path, many_parts):
    from pagewise.operators.digest import error_digest, update_digest, write_document
    rows = spark.range(800).select(F.lit(0).alias("run"), F.col("id").alias("pos"), F.concat(F.lit("u>"), "id").alias("url"),
                                   F.lit(None).cast("string").alias("image_cid"), F.lit("<m>\nn").alias("message")).repartition(6)
    for name, lines, sep in (("u", update_digest(rows, "run", "pos"), ""), ("e", error_digest(rows, "run", "pos"), "\n")):
        path = str(tmp_path / name)
        write_document(lines, path, sep)
        assert len(glob.glob(f"{path}/part-*")) > 1
        assert _files(path) == _document(lines, sep)


def _page(name, *links, more=""):
    body = "".join(f"<p>{name} has these words and more of them <a href='/{x}'>to {x}</a></p>" for x in links)
    return f"<html><body><main id='m'><h1>{name}</h1>{body}{more}</main></body></html>"


def test_run_from_file_to_files(spark, tmp_path):
    """Two runs over the saved list.  Changed, unchanged, blocked, missing, empty and slow pages; images by position."""
    from pagewise.plans.monitoring import monitor
    from pagewise.sources.watchlist import read_json
    at = "https://w.example"
    names = ["same", "new", "blocked", "missing", "void", "slow"]
    path = tmp_path / "watch.json"
    path.write_text(json.dumps([{"url": f"{at}/{n}"} for n in names] + [{"url": ""}], indent=4))
    robots = spark.createDataFrame([("w.example", "User-agent: *\nDisallow: /blocked")], "host string, robots_txt string")
    empty = spark.createDataFrame([(f"{at}/void",)], "url string")
    took = spark.createDataFrame([(i, s) for i, s in enumerate([1.0, 59.0, 99.0, 99.0, 99.0, 61.234])], "row_id long, duration_s double")

    def run(day, source, out, new_links, images):
        pages = spark.createDataFrame([(i, f"{at}/{n}", _page(n, *(new_links if n == "new" else ("x", "y")))) for i, n in enumerate(names) if n != "missing"],
                                      "page_id long, url string, html string")
        shots = spark.createDataFrame(images, "pos long, image_path string, image_cid string")
        return monitor(spark, source, pages, F.lit(f"2024-05-0{day} 10:00:00").cast("timestamp"), str(tmp_path / out), shots,
                       robots=robots, empty=empty, durations=took)
    new, changed, errors = run(1, str(path), "one", ("x",), [(0, "/shots/a.png", "cid-a"), (1, None, None), (7, "/shots/no.png", "cid-no")])
    assert [(r.url, r.pos, r.image_cid) for r in changed.orderBy("pos").collect()] == [
        (f"{at}/same", 0, "cid-a"), (f"{at}/new", 1, None), (f"{at}/slow", 2, None)]
    assert [tuple(r) for r in errors.orderBy("row_id").select("url", "message").collect()] == [
        (f"{at}/blocked", "Full scan returned None"), (f"{at}/missing", "Full scan returned None"), (f"{at}/void", "Empty result page detected"),
        (f"{at}/slow", "Processing time exceeded 60 sec -> 61.23 sec")]
    saved = {r.row_id: r for r in read_json(spark, str(tmp_path / "one" / "watch")).collect()}
    assert len(saved) == 7 and {r.run_code for r in saved.values()} == {"2024-05-01T10:00:00.000000Z"}
    assert saved[0].image_filename == "a.png" and saved[1].image_filename == "" and saved[6].url == ""
    assert saved[0].web_page_type == "plane" and saved[0].css_selector_list and saved[0].full_scan_datetime
    for i in (2, 3, 4):
        assert saved[i].css_selector_list == [] and saved[i].full_scan_datetime == "" and saved[i].result_vl == ""
    update = _files(tmp_path / "one" / "update")
    assert update.count("<li>") == 3 and 'src="cid:cid-a"' in update and update.index("/same") < update.index("/new")
    assert _files(tmp_path / "one" / "errors").count("<li>") == 4

    new, changed, errors = run(2, str(tmp_path / "one" / "watch"), "two", ("z", "x"), [(0, "/shots/b.png", "cid-b")])
    assert [r.url for r in changed.collect()] == [f"{at}/new"]
    saved = {r.row_id: r for r in read_json(spark, str(tmp_path / "two" / "watch")).collect()}
    assert saved[1].image_filename == "b.png" and saved[0].image_filename == "a.png"
    assert saved[0].full_scan_datetime.startswith("2024-05-01") and saved[0].updated_datetime.startswith("2024-05-01")   # a quick scan, no change
    assert saved[1].updated_datetime.startswith("2024-05-02") and saved[1].full_scan_datetime.startswith("2024-05-01")
