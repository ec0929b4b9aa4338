"""The web as a data source, over a server of its own that counts what it's asked for."""

import http.server
import threading
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from textloom.operators import scrape
from textloom.sources import pages, web


@pytest.fixture(scope="module")
def server():
    asked = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            self.send_response(404 if "missing" in self.path else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(f"<title>{self.path}</title><p>{'word ' * 200}</p>".encode())

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield SimpleNamespace(at=f"http://127.0.0.1:{s.server_port}", other=f"http://localhost:{s.server_port}", asked=asked)
    s.shutdown()


@pytest.fixture()
def folder(spark, server, tmp_path):
    rows = [(i, f"{server.at if i % 2 else server.other}/p{i}") for i in range(20)] + [(20, f"{server.at}/missing"), (21, "http://127.0.0.1:1/closed"), (22, None)]
    web.write_requests(spark.createDataFrame(rows, "pos int, url string"), f"{tmp_path}/requests", buckets=8, per_host=2)
    server.asked.clear()
    return f"{tmp_path}/requests"


def test_all_rows(spark, server, folder):
    rows = {r.pos: r for r in web.reading(spark, folder).collect()}
    assert sorted(rows) == list(range(22)) and sum(server.asked.values()) == 21
    assert rows[3].body.decode().startswith("<title>/p3<") and rows[3].http_status == 200 and rows[3].host == "127.0.0.1"
    assert rows[20].http_status == 404 and rows[20].fetch_error is None
    assert rows[21].http_status is None and "refused" in rows[21].fetch_error


@pytest.mark.parametrize("condition, positions", [
    ("pos IN (3, 4)", {3, 4}), ("host = 'localhost'", set(range(0, 20, 2))), ("pos >= 18 AND pos < 20", {18, 19}), ("url LIKE '%/p7'", {7}),
    ("host <> 'localhost' AND pos > 18", {19, 20, 21}), ("host IN ('nowhere')", set()), ("url IS NULL", set()), ("pos = 5 AND http_status = 200", {5}),
])
def test_what_is_filtered_is_not_fetched(spark, server, folder, condition, positions):
    found = {r.pos for r in web.reading(spark, folder).filter(condition).select("pos").collect()}
    assert found == positions
    assert sum(server.asked.values()) == len(positions - {21})


def test_hosts_choose_folders(spark, folder):
    def planned(*filters):
        r = web.WebReader(folder, None, "", 1, "")
        assert list(r.pushFilters(list(filters))) == []
        return {p.folder for p in r.partitions()}

    every, one = planned(), planned(ds.EqualTo(("host",), "localhost"))
    assert len(every) == 4 and len(one) == 2 and one < every
    assert planned(ds.EqualTo(("host",), "nowhere")) <= every and not planned(ds.In(("host",), (None,)))
    assert planned(ds.Not(ds.EqualTo(("host",), "localhost"))) == every


def test_buckets_are_those_of_the_writer(spark, tmp_path):
    rows = [(i, f"http://h{i % 40}.example.org/{i}") for i in range(400)] + [(400, "http://bücher.de/")]
    web.write_requests(spark.createDataFrame(rows, "pos int, url string"), f"{tmp_path}/r", buckets=16, per_host=3)
    for r in spark.read.parquet(f"{tmp_path}/r").select("host", "bucket").distinct().collect():
        assert r.bucket in {web.bucket_of(r.host, lane, 16) for lane in range(3)}


def test_filters_that_stay():
    r = web.WebReader("", None, "", 1, "")
    mine, others = ds.In(("pos",), (1, None)), ds.EqualTo(("http_status",), 200)
    assert list(r.pushFilters([mine, others])) == [others] and r.filters == [mine]
    row = {"pos": 2, "url": "http://ü/", "host": None}
    assert web._holds(mine, row) is None and web._holds(ds.Not(mine), row) is None
    assert web._holds(ds.EqualTo(("host",), "x"), row) is None and web._holds(ds.EqualNullSafe(("host",), None), row) is True
    assert web._holds(ds.GreaterThan(("url",), "http://z"), row) is True and web._holds(ds.StringContains(("url",), "ü"), row) is True


def test_rendered_and_openers(spark, folder):
    with pytest.raises(Exception, match="opener"):
        web.reading(spark, folder, kind="rendered").collect()
    rows = web.reading(spark, folder, kind="rendered", opener="tests.plain_browser:open_url").filter("pos < 4").collect()
    assert {(r.pos, r.raw_title, r.render_error) for r in rows} == {(0, "/p0", None), (1, None, "odd page"), (2, "/p2", None), (3, None, "odd page")}


def test_empty_and_whole_pipeline(spark, server, tmp_path):
    web.write_requests(spark.createDataFrame([], "pos int, url string"), f"{tmp_path}/none")
    assert web.reading(spark, f"{tmp_path}/none").collect() == []
    urls = [(i, f"{server.other}/s{i}") for i in range(6)]
    judged = scrape.judge_fetched(web.web_pages(spark, f"{tmp_path}/q", 4, 2)(spark.createDataFrame(urls, "pos int, url string")))
    done = scrape.fetch_results(judged).select("pos", "title", "success").orderBy("pos").collect()
    assert [tuple(r) for r in done] == [(i, f"/s{i}", True) for i in range(6)]
    assert pages.FETCH_CONCURRENCY == 6 and judged.filter(F.col("reason").isNotNull()).count() == 0
