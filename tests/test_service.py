"""The consumer as a service: numbered messages, timers, phases, crashes, poison, snapshots, states and counters."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import jobs
from textloom.schemas import ITEM_LOG, MESSAGE
from textloom.sources import pages
from textloom.sources.queue import Folder, QueueReader, QueueSource
from textloom.streaming import consumer, states, store, worker
from textloom.streaming.timers import hold

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def made_items(spark, job, names):
    lists = spark.createDataFrame([(job, names)], "j string, urls array<string>")
    return jobs.create_job(lists, F.col("j"), F.sha2("url", 256), F.lit("2024-01-01T00:00:00.000Z"))


def put(queue, name, messages):
    queue.mkdir(exist_ok=True)
    (queue / name).write_text("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages))


def message(i, **more):
    return {"type": "scrape_url", "jobId": "j", "itemId": f"i{i}", "url": f"http://h/{i}", "attempts": 1} | more


def until(test, seconds=60):
    end = time.time() + seconds
    while not (got := test()) and time.time() < end:
        time.sleep(0.3)
    return got


def stop(query):
    query.stop()
    query.awaitTermination(20)


def test_batches_count_messages(spark, tmp_path):
    """One file of 12 messages gives batches of 5, 5 and 2; a restart goes on; a late file with an early time isn't lost."""
    import os

    queue, seen = tmp_path / "queue", []
    put(queue, "a.json", [message(i) for i in range(12)])
    spark.dataSource.register(QueueSource)

    def start():
        stream = spark.readStream.format("textloom_queue").option("path", str(queue)).load()
        keep = lambda b, n: seen.append((n, [r.itemId for r in b.collect()])) if b.count() else None
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="200 milliseconds").start()

    query = start()
    until(lambda: sum(len(x) for _, x in seen) >= 12)
    assert [len(x) for _, x in seen] == [5, 5, 2] and [i for _, x in seen for i in x] == [f"i{i}" for i in range(12)]
    stop(query)
    put(queue, "0-late.json", ["no json", *[message(i) for i in range(12, 18)], "[1]"])
    os.utime(queue / "0-late.json", (1, 1))
    query = start()
    until(lambda: sum(len(x) for _, x in seen) >= 20)
    stop(query)
    assert [len(x) for _, x in seen[3:]] == [5, 3] and [i for _, x in seen[3:] for i in x] == [None, *[f"i{i}" for i in range(12, 18)], None]


def test_reader_offsets(tmp_path):
    queue = tmp_path / "queue"
    put(queue, "a.json", [message(i) for i in range(3)])
    put(queue, "_hidden.json", [message(9)])
    put(queue, "b.json", [message(i, attempts="2", not_before=True, url={"x": 1}) for i in range(3, 7)])
    r = QueueReader(str(queue), MESSAGE, 5, True)
    start = r.initialOffset()
    end = r.latestOffset()
    count = lambda r: r.latestOffset()["messages"]
    assert end.pop("began") > start.pop("began") == 0  # a new reader has news at least once
    parts = r.partitions(start, end)
    rows = [x for p in parts for x in r.read(p)]
    assert (start, end) == ({"messages": 0}, {"messages": 5}) and [x[2] for x in rows] == ["i0", "i1", "i2", "i3", "i4"]
    assert rows[3] == ("scrape_url", "j", "i3", '{"x":1}', None, None)  # what doesn't fit is null
    assert r.partitions(end, end) == []
    r.commit(end)
    assert Folder(str(queue)).names() == ["b.json"]  # a.json is read
    again = QueueReader(str(queue), MESSAGE, 5, True)
    again.partitions(end, end)  # as Spark does after a restart
    assert count(again) == 7 and again.latestOffset() == again.latestOffset()
    again.commit({"messages": 7})
    put(queue, "c.json", [message(7)])
    late = QueueReader(str(queue), MESSAGE, 5, True)
    late.partitions({"messages": 7}, {"messages": 7})
    assert count(late) == 8 and [x[2] for p in late.partitions({"messages": 7}, {"messages": 8}) for x in late.read(p)] == ["i7"]
    assert QueueReader(str(tmp_path / "none"), MESSAGE, 5, False).latestOffset()["messages"] == 0


def test_messages_wait_for_their_time(spark, tmp_path):
    """Nothing is written while a message waits; a restart keeps its timer; it comes once, when it is due."""
    queue, seen = tmp_path / "queue", []
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.dataSource.register(QueueSource)

    def start():
        stream = hold(spark.readStream.format("textloom_queue").option("path", str(queue)).load())
        keep = lambda b, n: seen.extend((time.time() * 1000, r.itemId, r.attempts, r.not_before) for r in b.collect())
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="200 milliseconds").start()

    due = int(time.time() * 1000) + 12_000
    put(queue, "a.json", [message(1), message(2, not_before=due, attempts=2), message(2, not_before=due + 2000, attempts=3), message(3, not_before=5), message(4, attempts=None)])
    query = start()
    until(lambda: len(seen) >= 3)
    assert sorted(x[1:] for x in seen) == [("i1", 1, None), ("i3", 1, 5), ("i4", None, None)]
    files = sorted(p.name for p in queue.rglob("*"))
    stop(query)
    query = start()
    until(lambda: len(seen) >= 5)
    stop(query)
    assert [x[1:] for x in seen[3:]] == [("i2", 2, due), ("i2", 3, due + 2000)] and all(x[0] >= x[3] for x in seen[3:])
    assert sorted(p.name for p in queue.rglob("*")) == files


def connectors(folder, poison="nothing"):
    """A fetch and a render that note each URL, and what happens to each by its name."""

    folder, clock = str(folder), time.time_ns

    def note(kind, url):
        with open(f"{folder}/{kind}-{clock()}", "w") as f:
            f.write(url)

    def one(url):
        note("fetch", url)
        if "down" in url:
            raise OSError("no route")
        return {"http_status": 200, "content_type": "text/html", "final_url": url + "#f", "body": f"<html><title>T</title><p>{'few' if 'script' in url else 'word ' * 300}</p></html>".encode()}

    def shown(url):
        note("render", url)
        if "norender" in url:
            raise RuntimeError("page crashed")
        return {"http_status": 0, "final_url": url, "raw_title": "R", "raw_text": "seen " * 100}

    def broken(fetch):
        """As fetch, but the whole job fails if the poisoned URL is in it."""

        def run(df):
            checked = df.withColumn("url", F.when(F.col("url").contains(poison), F.raise_error(F.lit("ValueError: poisoned"))).otherwise(F.col("url")))
            return fetch(checked)

        return run

    return broken(pages.fetcher(one, partitions=1)), pages.renderer(shown, partitions=1)


def noted(folder, kind):
    return Counter(p.read_text() for p in folder.iterdir() if p.name.startswith(kind))


def view(spark, places):
    return {r.url: r for r in jobs.latest_items(store.read_log(spark, places.log)).collect()}


@pytest.fixture
def places(tmp_path):
    (tmp_path / "notes").mkdir()
    return worker.Places(*(str(tmp_path / x) for x in ("log", "queue", "dead")))


class Crash(BaseException):
    pass


def test_phases_survive_a_crash(spark, tmp_path, places):
    """Fast results are there before a browser starts; the batch run again fetches nothing twice and ends each item once."""
    urls = [f"http://h/{x}" for x in ("ok", "script", "down", "norender", "script-norender")]
    consumer.submit(made_items(spark, "j1", [*urls, "http://10.0.0.1/"]), places.log, places.queue)
    batch = spark.read.schema(MESSAGE).json(places.queue)
    batch = batch.unionByName(batch)  # each message twice
    fetch, render = connectors(tmp_path / "notes")

    def crash(df):
        raise Crash

    with pytest.raises(Crash):
        worker.Batch(batch, 0, places, fetch, crash, lambda: 1000).run()
    got = view(spark, places)
    assert {u: r.status for u, r in got.items()} == {u: "processing" for u in urls} | {"http://h/ok": "completed", "http://h/norender": "completed", "http://10.0.0.1/": "failed"}
    assert got["http://h/ok"].title == "T" and got["http://h/ok"].final_url == "http://h/ok#f" and got["http://h/ok"].method == "fetch"
    worker.Batch(batch, 0, places, fetch, render, lambda: 1000).run()
    worker.Batch(batch, 0, places, fetch, render, lambda: 5000).run()  # and once more
    got = view(spark, places)
    assert noted(tmp_path / "notes", "fetch") == {u: 1 for u in urls} and noted(tmp_path / "notes", "render") == {f"http://h/{x}": 1 for x in ("script", "down", "script-norender")}
    assert {u: (r.status, r.method, r.error) for u, r in got.items()} == {
        "http://h/ok": ("completed", "fetch", None), "http://h/norender": ("completed", "fetch", None), "http://h/script": ("completed", "browser", None),
        "http://h/down": ("completed", "browser", None), "http://h/script-norender": ("queued", None, "page crashed"), "http://10.0.0.1/": ("failed", None, got["http://10.0.0.1/"].error),
    }
    retries = spark.read.schema(MESSAGE).json(f"{places.queue}/retry-0-b").collect()
    assert [(r.url, r.attempts, r.not_before) for r in retries] == [("http://h/script-norender", 2, 3000)]
    log = store.read_log(spark, places.log)
    assert Counter(r.kind for r in log.filter("url = 'http://h/ok'").collect()) == {"created": 1, "processing": 1, "result": 1}


def test_a_poisoned_message_is_found(spark, tmp_path, places):
    """One message makes the work raise: its neighbours finish in the same batch, it is retried and ends as a dead letter."""
    names = [f"http://h/{x}" for x in ("a", "b", "c", "poison", "script")]
    consumer.submit(made_items(spark, "j1", names), places.log, places.queue)
    batch = spark.read.schema(MESSAGE).json(places.queue)
    fetch, render = connectors(tmp_path / "notes", "poison")
    worker.Batch(batch, 0, places, fetch, render, lambda: 0).run()
    got = view(spark, places)
    assert {u: r.status for u, r in got.items()} == {u: "completed" for u in names} | {"http://h/poison": "queued"} and "poisoned" in got["http://h/poison"].error
    assert noted(tmp_path / "notes", "fetch") == {u: 1 for u in names if "poison" not in u}
    for n in (1, 2):
        [again] = [p for p in Folder(places.queue).names() if p.startswith(f"retry-{n - 1}-")]
        worker.Batch(spark.read.schema(MESSAGE).json(f"{places.queue}/{again}"), n, places, fetch, render, lambda: 0).run()
    dead = spark.read.json(places.dead).collect()
    assert [(r.url, r.status, r.attempts) for r in dead] == [("http://h/poison", "failed", 3)] and view(spark, places)["http://h/poison"].status == "failed"
    totals = jobs.job_view(jobs.latest_items(store.read_log(spark, places.log))).first()
    assert (totals.status, totals.total, totals.successful, totals.failed) == ("completed_with_errors", 5, 4, 1)


def test_service(spark, tmp_path, places):
    """Submitted, scraped, rendered, retried on time and given up, over several batches with compactions between."""
    names = [f"http://h/{x}" for x in ("a", "b", "c", "d", "script", "down", "script-norender")]
    consumer.submit(made_items(spark, "j1", names), places.log, places.queue)
    fetch, render = connectors(tmp_path / "notes")
    query = worker.serve(spark, places, str(tmp_path / "ckpt"), fetch, render, every=2, wait="500 milliseconds")
    ended = until(lambda: len(got := view(spark, places)) == 7 and all(r.status in jobs.TERMINAL for r in got.values()) and got, 150)
    until(lambda: any(p.name == "_SUCCESS" for p in (tmp_path / "dead").rglob("*")))  # written after the log
    raised = query.exception()
    stop(query)
    assert not raised and ended
    assert {u for u, r in ended.items() if r.status == "failed"} == {"http://h/script-norender"} and ended["http://h/script-norender"].error == "page crashed"
    assert noted(tmp_path / "notes", "render")["http://h/script-norender"] == 3 and noted(tmp_path / "notes", "fetch")["http://h/a"] == 1
    assert store.manifest(spark, places.log)["version"] >= 1
    assert [r.url for r in spark.read.json(places.dead).collect()] == ["http://h/script-norender"]


def log_rows(spark, n, batches, seed=0):
    """Log rows of n items over some batches, every kind among them."""
    import random

    r = random.Random(seed)
    rows = [(f"i{i}", f"j{i % 7}", f"u{i}", 0, "created", "queued", None, None, None, None, None, None, None, "t0") for i in range(n)]
    by = {-1: rows}
    for b in range(batches):
        by[b] = []
        for i in r.sample(range(n), n // 4):
            kind, status = r.choice([("processing", "processing"), ("retry", "queued"), ("result", "completed"), ("result", "failed"), ("dead", "failed")])
            got = kind == "result"
            seq = (b + 1) * 10 + (1 if kind == "processing" else 2)
            by[b].append((f"i{i}", f"j{i % 7}", f"u{i}", seq, kind, status, "fetch" if got else None, f"T{b}" if got else None, f"text {b}" if got else None, b if got else None, f"f{b}" if got else None, f"e{b}" if not got else None, b, f"t{b + 1}"))
    return {b: spark.createDataFrame(x, ITEM_LOG) for b, x in by.items()}


def test_snapshot_and_tail_equal_the_log(spark, tmp_path, capsys):
    log, rows = str(tmp_path / "log"), log_rows(spark, 300, 9)
    rows[-1].write.parquet(f"{log}/created/job=j")
    everything = rows[-1]
    for b in range(9):
        rows[b].write.parquet(f"{log}/batch_id={b}/part=b/phase=2")
        rows[b].write.parquet(f"{log}/_work/batch_id={b}/x")
        everything = everything.unionByName(rows[b])
        if b in (2, 5, 6):
            before, began = store.manifest(spark, log), store.read_log(spark, log)
            now = store.compact(spark, log, b - 1)
            assert now["version"] == before["version"] + 1 and now["through"] == b - 1
            assert Counter(jobs.latest_items(began).collect()) == Counter(jobs.latest_items(everything).collect())  # a reader from before
        want = Counter(jobs.latest_items(everything).collect())
        assert Counter(jobs.latest_items(store.read_log(spark, log)).collect()) == want
    # what the last compaction folded in is there for readers that began before; what the one before did is gone
    kept = [f"batch_id={n}" for n in (5, 6, 7, 8)]
    assert store.Files(spark).children(log) == ["_manifest", "_snapshot", "_work", *kept, "created"] and store.Files(spark).below(f"{log}/created") == []
    assert store.Files(spark).children(f"{log}/_work") == kept
    state = store.manifest(spark, log)
    assert len(state["buckets"]) > 20 and store.compact(spark, log, 5)["through"] == 5  # nothing new below
    some = spark.createDataFrame([("i3",), ("i77",), ("none",)], "id string")
    got = store.read_log(spark, log, some)
    files = {f.split("/log/")[1] for f in got.inputFiles()}
    buckets = {r[0] for r in some.select(store.bucket_of(F.col("id"))).collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in files if "_snapshot" in f} <= {str(b) for b in buckets}
    assert {f.split("/")[0] for f in files if "_snapshot" not in f} <= {"batch_id=6", "batch_id=7", "batch_id=8"}
    got.explain("formatted")
    assert "PushedFilters: [In(id, [i3,i77,none])]" in capsys.readouterr().out
    assert Counter(jobs.latest_items(got).collect()) == Counter(jobs.latest_items(everything.filter("id IN ('i3', 'i77')")).collect())
    many = everything.select("id").distinct()
    assert store.read_log(spark, log, many).select("id").distinct().count() == 300


def test_needed_rows_are_few(spark):
    rows = log_rows(spark, 40, 30, 3)
    log = rows[-1]
    for b in range(30):
        log = log.unionByName(rows[b])
    kept = store.needed(log.unionByName(log))
    assert kept.groupBy("id").count().agg(F.max("count")).first()[0] <= 3
    assert Counter(jobs.latest_items(kept).collect()) == Counter(jobs.latest_items(log).collect())


def test_states_and_counters_follow_the_log(spark, tmp_path):
    """After each batch the counters equal the rollup of the log's view; rows that come again change nothing."""
    rows, log, changes = log_rows(spark, 60, 5, 2), str(tmp_path / "log"), str(tmp_path / "changes")
    table, everything = {}, None

    def upsert(batch, n):
        table.update({r.job_id: tuple(r)[1:] for r in batch.collect()})

    for b in (-1, 0, 1, 1, 2, 0, 3, 4):
        rows[b].coalesce(1).write.mode("append").parquet(log)
        everything = rows[b] if everything is None else everything.unionByName(rows[b])
        states.keep_changes(spark.readStream.schema(ITEM_LOG).parquet(log), changes, str(tmp_path / "c1")).awaitTermination()
        stream = spark.readStream.schema(states.CHANGE).option("recursiveFileLookup", "true").parquet(changes)
        states.keep_counters(stream, upsert, str(tmp_path / "c2")).awaitTermination()
        want = {r.job_id: (r.total, r.completed, r.successful, r.failed) for r in jobs.rollup(jobs.latest_items(everything)).collect()}
        assert table == want
    last = spark.read.option("recursiveFileLookup", "true").parquet(changes).groupBy("id").agg(F.max_by("status", "seq").alias("s"))
    assert {r.id: r.s for r in last.collect()} == {r.id: r.status for r in jobs.latest_items(everything).collect()}


def test_states_expire(spark, tmp_path):
    log, changes = str(tmp_path / "log"), str(tmp_path / "changes")
    row = ("i", "j", "u", 5, "result", "completed", None, None, None, None, None, None, None, "t")
    for n in range(2):  # the second comes when the first is forgotten, so it counts as new
        spark.createDataFrame([row], ITEM_LOG).write.mode("append").parquet(log)
        states.keep_changes(spark.readStream.schema(ITEM_LOG).parquet(log), changes, str(tmp_path / "c"), expire_ms=1).awaitTermination()
        time.sleep(0.1)
    assert [r.was for r in spark.read.option("recursiveFileLookup", "true").schema(states.CHANGE).parquet(changes).collect()] == [None, None]
