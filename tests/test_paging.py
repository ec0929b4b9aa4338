"""Pages by position: gapless numbers of hot and small jobs, pages of the store against a sort, files that a page reads."""

from collections import Counter

from pyspark.sql import functions as F

from textloom.operators import jobs
from textloom.schemas import ITEM_LOG
from textloom.streaming import paging, store


def created(spark, job, n, seed=0):
    rows = [(f"{job}-{(i * 7919 + seed) % 100003:06d}", job, f"http://h/{i}", 0, "created", "queued", *[None] * 7, "t0") for i in range(n)]
    return spark.createDataFrame(rows, ITEM_LOG)


def test_positions(spark):
    """A job over many ranges, small ones within a range, ties, nulls and an empty table."""
    rows = [("hot", f"t{i % 3}", f"i{i:04d}") for i in range(900)] + [(f"j{i % 40}", None if i % 5 == 0 else "t", f"k{i:03d}") for i in range(200)]
    rows += [(None, "t", "x"), (None, "t", "y"), ("twice", "t", "same"), ("twice", "t", "same")]
    items = spark.createDataFrame(rows, "job_id string, created_at string, id string").repartition(7)
    want = Counter()
    for job in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == job), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        want.update((*r, n) for n, r in enumerate(mine))
    for size in (40, 333, 10_000):
        got = paging.positions(items, size)
        assert got.columns == ["job_id", "created_at", "id", "position"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert paging.positions(items.filter("false")).count() == 0


def test_pages_of_a_store(spark, tmp_path, monkeypatch):
    """Before, between and after compactions each page equals that of a sort; a late page reads as few files as the first."""
    monkeypatch.setattr(paging, "CHUNK", 50)
    log = str(tmp_path / "log")
    everything = created(spark, "big", 430)
    everything.write.parquet(f"{log}/created/job=big")

    def add(rows, path):
        nonlocal everything
        rows.coalesce(2).write.parquet(f"{log}/{path}")
        everything = everything.unionByName(rows)

    def check(job, page, limit, text=False):
        items = jobs.latest_items(everything)
        got, want = paging.results_page(spark, log, job, page, limit, text), jobs.results_page(items, job, page, limit, text)
        assert got.columns == want.columns and got.collect() == want.collect()

    def done(job, batch, every):
        rows = everything.filter((F.col("job_id") == job) & (F.col("kind") == "created")).filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
        result = jobs.transition("result", "completed", method=F.lit("fetch"), title=F.lit(f"T{batch}"), text=F.lit("x"), text_length=F.lit(batch), ts=F.lit(f"t{batch + 1}"))
        return rows.select("id", "job_id", "url", F.lit((batch + 1) * 10 + 2).alias("seq"), *result).select(*[F.col(f.name).cast(f.dataType) for f in ITEM_LOG.fields])

    check("big", "2", "20")  # from the submission: nothing is indexed
    add(done("big", 0, 2), "batch_id=0")
    store.compact(spark, log, 0)
    check("big", "21", "20", True)  # folded in, not indexed yet
    assert [p["n"] for p in paging.index(spark, log)["parts"]] == [430]
    assert paging.index(spark, log)["version"] == 1  # nothing new
    check("big", "1", "20", True)
    check("big", "22", "20")  # ten rows, the last
    check("big", "23", "20")
    check("none", "1", "5")
    # a page over the end of a chunk, and with what came after the index
    add(done("big", 1, 3), "batch_id=1")
    check("big", "3", "20", True)
    first, late = (paging.places(spark, log, "big", at, at + 10).inputFiles() for at in (0, 400))
    # ranges that are dealt by a sample may cut a chunk in two
    assert 1 <= len(first) <= 2 and 1 <= len(late) <= 2 and all("chunk=0" in f for f in first) and all("chunk=8" in f for f in late)
    for n, job in enumerate(("a", "b", "c")):
        add(created(spark, job, 30 + n, n), f"created/job={job}")
        add(done(job, 2 + n, 2), f"batch_id={2 + n}")
        check(job, "2", "20")
        store.compact(spark, log, 2 + n)
        if job == "b":
            continue  # as if a crash came between
        now = paging.index(spark, log)
        check(job, "2", "20", True)
    assert [p["n"] for p in now["parts"]] == [430, 93] and now["through"] == store.manifest(spark, log)["version"]
    for job in ("big", "a", "b", "c"):
        check(job, "1", None)
        check(job, "2", "17")
    assert paging._read(spark, log, [p["v"] for p in now["parts"]]).count() == 523  # once each
    assert store.Files(spark).children(f"{log}/_positions")[:1] == ["_manifest"] and "_staging" not in store.Files(spark).children(f"{log}/_positions")
    kept = [v for v in store.Files(spark).children(f"{log}/_positions") if v.startswith("v=")]
    assert set(kept) >= {f"v={p['v']}" for p in now["parts"]} and len(kept) <= 3
    monkeypatch.setattr(paging, "_created", None)  # an indexed job never goes back to the submissions
    assert paging.results_page(spark, log, "big", "22", "20").count() == 10
