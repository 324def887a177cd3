import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from loomweb.plans import search
from loomweb.sources import http as pages_http
from loomweb.sources import tables
from loomweb.streaming import incremental, limits

from .test_planning import bucket


class Site(http.server.BaseHTTPRequestHandler):
    fails = {"/flaky": 1}

    def do_GET(self):
        if self.fails.get(self.path, 0):
            self.fails[self.path] -= 1
            return self.send_error(503)
        if self.path == "/moved":
            return self.answer(302, location="/page")
        if self.path == "/away":
            return self.answer(302, location="http://elsewhere.invalid/")
        if self.path == "/loop":
            return self.answer(302, location="/loop")
        if self.path == "/missing":
            return self.send_error(404)
        self.answer(200, "text/plain" if self.path == "/text" else "text/html; charset=utf-8", b"<p>hi</p>")

    def answer(self, code, kind="text/html", body=b"", location=None):
        self.send_response(code)
        self.send_header("content-type", kind)
        if location:
            self.send_header("location", location)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_over_http(spark, site):
    asked = [site + p for p in ("/page", "/moved", "/away", "/loop", "/missing", "/text", "/flaky")]
    spark.dataSource.register(pages_http.PageSource)
    rows = spark.read.format("loomweb_pages").option("urls", json.dumps(asked)).option("rate", "0").option("delay", "0.01").load().collect()
    by = {r.requested_url.removeprefix(site): r for r in rows}
    assert by["/moved"].final_url == site + "/page" and by["/flaky"].html == "<p>hi</p>"
    assert [by[p].reason for p in ("/away", "/loop", "/missing", "/text")] == ["redirect leaves the site", "redirect loop", "HTTP 404", "not a page"]
    frame = pages_http.fetched(spark.createDataFrame([(u,) for u in asked[:3]], "url string"), pages_http.Policy(rate=0, delay=0.01))
    assert [r.url for r in pages_http.accepted(frame).collect()] == [site + "/page"] and pages_http.rejected(frame).count() == 1


def test_job_table_versions(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert tables.read_jobs(spark, path).count() == 0
    tables.write_jobs(tables.new_job(spark, "http://h/", ["a"], "interval", hours=2, name="one"), path)
    job = tables.read_jobs(spark, path)
    assert job.first().schedule.hours == 2 and len(job.first().id) == 12
    tables.write_jobs(job.withColumn("name", F.lit("two")), path)
    assert [r.name for r in tables.read_jobs(spark, path).collect()] == ["two"]
    (tmp_path / "jobs.json").write_text(json.dumps({"jobs": [{"id": "x", "keywords": ["k"], "schedule": {"kind": "daily", "time": "08:00"}}]}))
    (tmp_path / "bad.json").write_text("{oops")
    assert tables.read_job_file(spark, str(tmp_path / "jobs.json")).first().schedule.time == "08:00"
    assert tables.read_job_file(spark, str(tmp_path / "bad.json")).count() == 0 and tables.read_job_file(spark, str(tmp_path / "none.json")).count() == 0


def test_watch_reports_only_new_hits(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    page = lambda i, body: [(i, f"http://h/{i}", f"<body>{body}</body>")]
    schema = "page_id long, url string, html string"
    for rows in (page(1, "word one"), page(1, "word one") + page(2, "a word")):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(source))
        incremental.watch(spark.readStream.schema(schema).parquet(str(source)), ["word"], folder).awaitTermination()
    assert sorted((r.batch, r.url) for r in spark.read.parquet(f"{folder}/hits").select("batch", "url").collect()) == [(0, "http://h/1"), (1, "http://h/2")]


def test_bucket_lasts_over_batches(spark, tmp_path):
    source, schema = tmp_path / "in", "host string, seq long, at double"
    at = [0.0, 0.0, 0.1, 0.2, 5.0, 5.0, 5.0, 5.1]
    for n in (0, 4):
        spark.createDataFrame([("h", i, at[i]) for i in range(n, n + 4)], schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = limits.admitted(spark.readStream.schema(schema).parquet(str(source)), 2.0)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = [r.admitted_at for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == pytest.approx(bucket(at, 2.0))


def test_late_events_are_dropped(spark, tmp_path):
    source, schema = tmp_path / "in", "ts timestamp_ntz, event_type string"
    for day in ("2024-01-01 10:00:00", "2024-01-02 10:00:00", "2024-01-01 10:01:00"):
        spark.sql(f"SELECT timestamp_ntz'{day}' AS ts, 'x' AS event_type").coalesce(1).write.mode("append").parquet(str(source))
        stream = incremental.event_rates(spark.readStream.schema(schema).parquet(str(source)))
        stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


def test_search_and_jobs(spark):
    snapshot = spark.createDataFrame([(1, "http://h/", "<title>Home page title</title><body><script>$.ajax()</script><a href='/n/1.html'>go</a></body>"), (2, "http://h/n/1.html", "<title>Second page title</title><body><article>教育 item 2024-01-05</article></body>")], "page_id long, url string, html string")
    rendered = snapshot.withColumn("html", F.concat("html", F.lit("<p>教育 more</p>")))
    found = search.search(snapshot, ["教育"], rendered, expand=lambda words: ["教学", "x"])
    assert found.rendered and found.results.count() == 2
    assert not search.search(snapshot, ["title"], snapshot).rendered
    assert {(r.page_id, r.level) for r in search.crawl(snapshot, "http://h/#x", 1).collect()} == {(1, 0), (2, 1)}
    first = search.run_job(snapshot, ["教育"], None)
    assert first.new_hits.count() == 0 and first.summary.first().new_hits is None and first.summary.first().total_hits == 1
    again = search.run_job(rendered, ["教育"], first.state, "2024-01-04T00:00:00")
    assert again.summary.first().new_hits == 2
    assert search.run_job(rendered, ["教育"], first.state, "2024-01-05T09:00:00").summary.first().new_hits == 1
    prompt = search.summarize(found.results, ["教育"]).first()
    assert prompt.n_blocks == 2 and "Second page title" in prompt.content
    made = search.summarize(found.results, ["教育"], lambda p: "【概述】ok\n【条目】\n《T》\ns\nhttp://h/1").first()
    assert made.overview == "ok" and made.entries[0].link == "http://h/1"
    assert search.ask(found.results, ["a"], "why?").first().content.endswith("问题：why?")
    assert search.response(found).count() == 2 and search.entries(found.results).count() >= 1


def test_discovery_and_recall(spark):
    snapshot = spark.createDataFrame([(1, "http://h.com/a", "<body><article>one word</article></body>")], "page_id long, url string, html string")
    rows = [(0, "http://h.com/a#x", "s", 9, None, "t"), (1, "http://h.com/b", "s", 3, "2024-01-01", "a word"), (2, "http://h.com/c", "s", 7, None, "none"), (3, "http://other.org/d", "s", 8, None, "word"), (4, "http://h.com/login/e", "s", 8, None, "word")]
    found = spark.createDataFrame(rows, "pos long, url string, source string, score int, published_date string, title_hint string").withColumn("source_evidence", F.array().cast("array<string>"))
    assert [r.norm_url for r in search.discover(found, snapshot, "h.com", allowed=["h.com"]).collect()] == ["http://h.com/c", "http://h.com/b"]
    ranked = search.search_with_recall(snapshot, found, ["word"]).collect()
    assert [(r.norm_url, r.strength) for r in ranked] == [("http://h.com/a", "strong"), ("http://h.com/b", "weak"), ("http://h.com/login/e", "weak"), ("http://other.org/d", "weak")]
