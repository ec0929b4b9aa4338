from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.functions import classify, urls
from textloom.operators import jobs, scrape, url_list
from textloom.plans import queries as core
from textloom.schemas import MESSAGE
from textloom.sources import pages
from textloom.streaming import consumer


def test_url_lists(spark):
    bodies = [('{"urls": [" http://EX.com ", 5, "http://ex.com/", "http://b.com/x#y"]}', ["http://ex.com/", "http://b.com/x#y"], None), ('{"urls": "x"}', None, urls.NOT_A_LIST), ("nonsense", None, urls.NOT_JSON), ('{"urls": ["http://a.com"', None, urls.NOT_JSON),
              ('{"urls": []}', None, urls.NO_URL), ('{"urls": ["http://a.com", "bad", "ftp://x"]}', None, urls.INVALID_URL), ('{"urls": ["http://a.com", "http://b.com", "http://c.com"]}', None, urls.TOO_MANY.format(2))]
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(bodies)], "request_id int, body string")
    got = {r["request_id"]: (r["urls"], r["error"]) for r in url_list.normalize_lists(url_list.parse_request(df), 2).collect()}
    assert [got[i] for i in range(len(bodies))] == [b[1:] for b in bodies]


def test_scrape_keeps_order_and_isolates_errors(spark):
    good = "<html><title>T</title><body>" + "word " * 200 + "</body></html>"

    def fetch_one(url):
        if "boom" in url:
            raise ValueError("no route")
        kind = "application/pdf" if "pdf" in url else "text/html"
        return {"http_status": 404 if "404" in url else 200, "content_type": kind, "final_url": url, "body": good.encode()}

    def render_one(url):
        if "404" in url:
            raise RuntimeError("closed")
        return {"http_status": None, "final_url": url, "raw_title": "R", "raw_text": "x" * 100}

    names = ["http://a.com/", "http://boom.com/", "http://b.com/pdf", "http://c.com/404", "https://www.flashscore.com/mac/1"]
    req = spark.createDataFrame(list(enumerate(names)), "pos int, url string")
    rows = scrape.scrape(req, pages.fetcher(fetch_one), pages.renderer(render_one), ordered=True).collect()
    assert [r.requestedUrl for r in rows] == names
    assert [r.success for r in rows] == [True, True, True, False, True]
    assert [r.method for r in rows] == ["fetch"] + ["browser"] * 4
    assert [r.fallbackReason for r in rows] == [None, "no route", classify.REASON_NOT_HTML + "application/pdf", classify.REASON_SCRIPTED, classify.REASON_SPECIAL]
    assert rows[3].error == "closed" and rows[1].status == 200 and rows[0].title == "T"
    s = scrape.summarize(spark.createDataFrame(rows, scrape.RESULT), with_results=True).first()
    assert (s.requested, s.successful, s.failed, s.fetchCount, s.browserCount, s.success) == (5, 4, 1, 1, 4, True)
    assert [x.pos for x in s.results] == list(range(5))


def test_failed_launch_is_every_rows_error(spark):
    def launch():
        raise RuntimeError("no browser")

    req = spark.createDataFrame([(0, "u"), (1, "v")], "pos int, url string")
    assert {r.render_error for r in pages.launched(launch)(req).collect()} == {"no browser"}


def test_latest_state_merges_by_column(spark):
    rows = [("i", 1, "created", "queued", None, None), ("i", 2, "result", "completed", "T", None), ("i", 3, "dead", "failed", None, "late")]
    log = spark.createDataFrame(rows, "id string, seq long, kind string, status string, title string, error string")
    for c, t in dict(job_id="string", url="string", method="string", text="string", final_url="string", ts="string", text_length="long", duration_ms="long").items():
        log = log.withColumn(c, F.lit(None).cast(t))
    r = jobs.latest_items(log).first()
    assert (r.status, r.title, r.error, r.text_length) == ("failed", "T", "late", 0)


def test_urls_are_checked_before_anything_is_fetched(spark):
    def one(url):
        if url != "http://ex.com/b":
            raise AssertionError(url)
        return {"http_status": 200, "content_type": "text/html", "final_url": url, "body": ("<title>t</title>" + "word " * 300).encode()}

    given = ["HTTP://EX.com/a/../b", "http://10.0.0.1/", "nonsense", "ftp://ex.com/", None]
    rows = scrape.scrape(spark.createDataFrame(list(enumerate(given)), "pos int, url string"), pages.fetcher(one), pages.renderer(one), ordered=True).collect()
    assert [(r.requestedUrl, r.success, r.method, r.error) for r in rows] == [
        ("http://ex.com/b", True, "fetch", None), ("http://10.0.0.1/", False, None, urls.PRIVATE_HOST), ("nonsense", False, None, urls.INVALID_URL), ("ftp://ex.com/", False, None, urls.ONLY_HTTP),
        (None, False, None, urls.INVALID_URL),
    ]


def test_statuses_of_the_fast_fetch(spark):
    """A 404 has its status, type and body, and goes on to the browser for that; a 200 in English asks for no browser."""
    import http.server
    import threading

    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(dict(self.headers))
            body = ("<html><title>T</title>" + "word " * 300).encode()
            self.send_response(404 if "missing" in self.path else 200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    got = {r.pos: r for r in pages.fetcher()(spark.createDataFrame([(0, at + "/ok"), (1, at + "/missing"), (2, "http://127.0.0.1:1/")], "pos int, url string")).collect()}
    judged = {r.pos: r for r in scrape.judge_fetched(spark.createDataFrame(list(got.values()), pages.FETCHED)).collect()}
    server.shutdown()
    assert [got[i].http_status for i in range(3)] == [200, 404, None] and got[1].content_type.startswith("text/html") and b"word" in got[1].body and got[1].fetch_error is None
    assert judged[0].reason is None and judged[1].reason == classify.REASON_SCRIPTED and judged[2].reason == got[2].fetch_error != ""
    assert seen[0]["Accept-Language"] == pages.ACCEPT_LANGUAGE and seen[0]["Accept"] == pages.ACCEPT


def test_pool_and_browser_of_a_task(spark, tmp_path):
    folder = str(tmp_path)

    class Browser:
        def __init__(self):
            import uuid

            self.name = f"{folder}/{uuid.uuid4().hex}"
            open(self.name + ".open", "w").close()

        def __call__(self, url):
            return {"final_url": url, "raw_title": self.name, "raw_text": "x"}

        def close(self):
            open(self.name + ".closed", "w").close()

    req = spark.createDataFrame([(i, f"u{i}") for i in range(150)], "pos int, url string")
    rows = pages.launched(Browser, partitions=2)(req).collect()
    names = {p.name for p in tmp_path.iterdir()}
    opened = {n[:-5] for n in names if n.endswith(".open")}
    assert len(rows) == 150 and {r.raw_title.rsplit("/", 1)[1] for r in rows} == opened and len(opened) == 2
    assert {n[:-7] for n in names if n.endswith(".closed")} == opened
    assert pages.fetcher(lambda u: {"http_status": 200})(req).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_page_is_set_up_waited_for_and_closed():
    class Page:
        def __init__(self, slow=False):
            self.did, self.slow = [], slow

        def configure(self, s):
            self.did.append(("configure", s.width, s.height, s.headers["Accept-Language"]))

        def goto(self, url, timeout):
            self.did.append(("goto", url, timeout))
            return 200

        def wait_until(self, test, timeout):
            self.did.append(("until", test("y" * 1001), test("y" * 1000), test("Loading..." + "y" * 1001), timeout))
            if self.slow:
                raise TimeoutError

        def wait_idle(self, idle, timeout):
            self.did.append(("idle", idle, timeout))
            if self.slow:
                raise TimeoutError

        def url(self):
            return "final"

        def title(self):
            return "T"

        def text(self):
            return "x"

        def close(self):
            self.did.append("close")
            raise OSError

    paused = []
    for special, slow, want in ((True, False, []), (True, True, [5]), (False, False, []), (False, True, [1.5])):
        page = Page(slow)
        row = pages.open_page(page, "u", special, pause=paused.append)
        assert row == {"http_status": 200, "final_url": "final", "raw_title": "T", "raw_text": "x"} and paused == want
        assert page.did == [("configure", 1440, 1200, pages.ACCEPT_LANGUAGE), ("goto", "u", 30), ("until", True, False, False, 15) if special else ("idle", 1, 10), "close"]
        paused.clear()


def made_items(spark, job, names):
    lists = spark.createDataFrame([(job, names)], "j string, urls array<string>")
    return jobs.create_job(lists, F.col("j"), F.sha2("url", 256), F.lit("2024-01-01T00:00:00.000Z"))


def test_submissions_keep_each_other(spark, tmp_path):
    log, queue = str(tmp_path / "log"), str(tmp_path / "queue")
    for job, n in (("j1", 3), ("j2", 2), ("j2", 2)):  # the last one again
        consumer.submit(made_items(spark, job, [f"http://{job}/{i}" for i in range(n)]), log, queue)
    view = {r.job_id: (r.status, r.total, r.created_at) for r in jobs.job_view(jobs.latest_items(consumer.read_log(spark, log)), consumer.read_jobs(spark, log)).collect()}
    assert view == {"j1": ("queued", 3, "2024-01-01T00:00:00.000Z"), "j2": ("queued", 2, "2024-01-01T00:00:00.000Z")}
    assert {(r.id, r.kind, r.total) for r in consumer.read_jobs(spark, log).collect()} == {("j1", "created", 3), ("j2", "created", 2)}

    def send(rows, to):
        raise OSError("full")

    with pytest.raises(OSError):
        consumer.submit(made_items(spark, "j3", ["http://j3/"]), log, queue, send)
    items = jobs.latest_items(consumer.read_log(spark, log))
    assert {(r.status, r.error) for r in items.filter("job_id = 'j3'").collect()} == {("failed", jobs.ENQUEUE_FAILED + "full")}
    lost = jobs.get_job(jobs.job_view(items, consumer.read_jobs(spark, log)), "j3").collect()
    assert [(r.job_id, r.status, r.total, r.completed, r.successful, r.failed, r.progress) for r in lost] == [("j3", "failed", 1, 1, 0, 1, 100)] and lost[0].updated_at > lost[0].created_at
    one = jobs.get_item(items, items.filter("job_id = 'j1'").first().id)
    assert one.count() == 1 and "text" not in one.columns and jobs.get_job(jobs.job_view(items), "none").count() == 0


def test_consumer(spark, tmp_path):
    log, queue, dead = (str(tmp_path / x) for x in ("log", "queue", "dead"))
    consumer.submit(made_items(spark, "j1", ["http://ok/", "http://bad/", "http://raise/"]), log, queue)
    spark.createDataFrame([("other", "j1", "x", "u", 1, None), ("scrape_url", "j1", "unknown", "u", 1, None)], MESSAGE).write.mode("append").json(queue)

    def work(df):
        bad, err = F.col("url").contains("bad"), F.col("url").contains("raise")
        return df.select("id", (~bad).alias("success"), err.alias("raised"), F.lit("fetch").alias("method"), F.lit("T").alias("title"), F.lit("x").alias("text"), F.lit(1).alias("text_length"),
                         F.col("url").alias("final_url"), F.lit(1).alias("duration_ms"), F.when(err, "oops").alias("error"))

    def state(at):
        consumer.consume(spark, log, queue, dead, str(tmp_path / "ckpt"), work, once=True, clock=lambda: at).awaitTermination()
        return {r.url: r for r in jobs.latest_items(consumer.read_log(spark, log)).collect()}

    # a second, then two are too early for the first retry, and three seconds for the next
    status = [state(at)["http://raise/"].status for at in (0, 1000, 1999, 2000, 5999, 6000)]
    assert status == ["queued", "queued", "queued", "queued", "queued", "failed"]
    attempts = consumer.read_log(spark, log).filter("kind = 'processing' AND url = 'http://raise/'").count()
    got = state(10**9)
    assert attempts == 3 and [got[u].status for u in ("http://ok/", "http://bad/", "http://raise/")] == ["completed", "failed", "failed"]
    assert got["http://raise/"].error == "oops" and got["http://raise/"].title is None
    view = jobs.job_view(jobs.latest_items(consumer.read_log(spark, log))).first()
    assert (view.status, view.total, view.successful, view.failed, view.progress) == ("completed_with_errors", 3, 1, 2, 100)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_duckdb(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(core.SQL[name])
    names = sorted(want.columns)
    got = entry.queries()[name](spark, data)
    assert sorted(got.columns) == names
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    count = lambda rs: Counter(repr([r[c] for c in names]) for r in rs)
    assert count(r.asDict() for r in got.collect()) == count(rows)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
