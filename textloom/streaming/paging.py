"""Pages of a job's results by position: no page sorts the job's items or skips those before it.

    <log>/_positions/_manifest/<version>.json    through: the store's version indexed; parts: versions and rows
    <log>/_positions/v=<version>/bucket=<b>/chunk=<c>/    job_id, position, id

An item's place in its job, by time of creation and id, never changes, since a job's items come in one submission.
So the index only grows: what a compaction folded in is added as a part, and parts are put together while
the one before isn't much larger, which keeps them few (a logarithm of their number) and rewrites a row as
seldom. A page reads the one or two chunks with its positions, by job and position, and of the log the
buckets' files of its items (store.read_log): as much for page 1,000 as for page 1. Only a job that no compaction has
folded in and indexed yet is sorted, from its submission.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import jobs
from textloom.sources.tables import scratch
from textloom.streaming.store import Files, _rows, bucket_of, manifest, read_log, tail_paths

#: Positions of a job in one folder, and rows of a file.
CHUNK = 1_000_000
POSITIONS = "job_id string, position bigint, id string"


def positions(items: DataFrame, rows_a_range: int = CHUNK, staging: str | None = None) -> DataFrame:
    """items (job_id, created_at, id) with position: from 0 without a gap in each job, by created_at (nulls first) and id.

    Items are cut into ranges of their order, so a job with a third of all rows is many ranges. They are numbered
    within range and job; what a job has in earlier ranges is added. Only a range's first job can have
    any there, so there is at most one such number a range. Rows alike in all three are numbered in any order.
    The ranges are kept in staging, a folder that is written anew (a scratch folder if none is named).
    """
    spark = items.sparkSession
    order = ["job_id", "created_at", "id"]
    at = staging or scratch(spark, "positions")
    ranges = max(1, math.ceil(items.count() / rows_a_range))
    items.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).write.mode("overwrite").parquet(at)  # written, so that ranges stay as they are
    placed = spark.read.parquet(at)
    counted = placed.groupBy("job_id", "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("job_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("_before", F.sum("n").over(earlier)).filter("_before > 0").select(F.col("job_id").alias("_job"), F.col("_range").alias("_r"), "_before")
    # `ranges` rows at most: a range's first job alone goes on from an earlier one
    before = F.broadcast(before) if ranges <= 100_000 else before
    within = F.row_number().over(Window.partitionBy("_range", "job_id").orderBy("created_at", "id")) - 1
    numbered = placed.withColumn("_within", within).join(before, F.col("job_id").eqNullSafe(F.col("_job")) & (F.col("_range") == F.col("_r")), "left")
    return numbered.withColumn("position", F.col("_within") + F.coalesce("_before", F.lit(0))).select(*items.columns, "position")


def _index(spark: SparkSession, log: str) -> dict:
    files, at = Files(spark), f"{log}/_positions/_manifest"
    names = [n for n in files.children(at) if n.endswith(".json")]
    return json.loads(files.read(f"{at}/{names[-1]}")) if names else {"version": 0, "through": 0, "parts": []}


def _read(spark: SparkSession, log: str, parts: list[int], buckets: list[int] | None = None, chunks: list[int] | None = None) -> DataFrame:
    """Rows of the index, only from folders that are there and may have them."""
    files, paths = Files(spark), []
    for v in parts:
        top = f"{log}/_positions/v={v}"
        if buckets is None:
            paths.append(top)
            continue
        folders = [f"{top}/bucket={b}" for b in buckets]
        paths += [p for f in folders for p in ([f] if chunks is None else [f"{f}/chunk={c}" for c in chunks]) if files.exists(p)]
    if not paths:
        return spark.createDataFrame([], POSITIONS)
    return spark.read.schema(POSITIONS).option("recursiveFileLookup", "true").parquet(*paths)


def _created(rows: DataFrame) -> DataFrame:
    """Items by their first log row, once each."""
    return rows.filter("kind = 'created'").groupBy("id").agg(F.min("job_id").alias("job_id"), F.min("ts").alias("created_at"))


def index(spark: SparkSession, log: str) -> dict:
    """Adds the jobs that the last compaction folded in; the new manifest. Nothing is done twice, after a crash either.

    If compactions went by without it, all created rows of the log are looked through instead.
    """
    state, have = manifest(spark, log), _index(spark, log)
    if state["version"] == have["through"]:
        return have
    missed = state["version"] > have["through"] + 1
    if not missed and not state["folded"]:
        return _put(Files(spark), log, have, {"version": have["version"] + 1, "through": state["version"], "parts": have["parts"]})
    new = _created(read_log(spark, log) if missed else _rows(spark, state["folded"]))
    buckets = None if missed else [r[0] for r in new.select(bucket_of(F.col("job_id"))).distinct().collect()]  # BUCKETS numbers at most
    known = _read(spark, log, [p["v"] for p in have["parts"]], buckets).filter("position = 0").select("job_id")
    rows = positions(new.join(known, "job_id", "left_anti"), CHUNK, f"{log}/_positions/_staging")
    version, parts, n = have["version"] + 1, list(have["parts"]), spark.read.parquet(f"{log}/_positions/_staging").count()
    joined = []
    while parts and n and parts[-1]["n"] <= 2 * n:
        joined.append(parts.pop())
        n += joined[-1]["n"]
    if n:
        every = rows.select("job_id", "position", "id").unionByName(_read(spark, log, [p["v"] for p in joined]))
        every = every.withColumns({"bucket": bucket_of(F.col("job_id")), "chunk": F.floor(F.col("position") / CHUNK)})
        dealt = every.repartitionByRange(math.ceil(n / CHUNK), "bucket", "chunk", "job_id", "position").sortWithinPartitions("bucket", "chunk", "job_id", "position")
        dealt.write.mode("overwrite").partitionBy("bucket", "chunk").parquet(f"{log}/_positions/v={version}")
        parts.append({"v": version, "n": n})
    return _put(Files(spark), log, have, {"version": version, "through": state["version"], "parts": parts})


def _put(files: Files, log: str, have: dict, now: dict) -> dict:
    """Puts the manifest in force and deletes parts that neither it nor the one before has: a reader that began before is done by then."""
    at = f"{log}/_positions"
    files.create(f"{at}/_manifest/{now['version']:012d}.json", json.dumps(now))
    used = {f"v={p['v']}" for p in [*now["parts"], *have["parts"]]}
    for v in files.children(at):
        if v.startswith("v=") and v not in used:
            files.delete(f"{at}/{v}")
    files.delete(f"{at}/_staging")
    for old in files.children(f"{at}/_manifest")[:-2]:
        files.delete(f"{at}/_manifest/{old}")
    return now


def places(spark: SparkSession, log: str, job_id: str, start: int, end: int) -> DataFrame:
    """(position, id) of a job's items from position start to before end."""
    of_job = spark.range(1).select(bucket_of(F.lit(job_id))).first()[0]
    parts = [p["v"] for p in _index(spark, log)["parts"]]
    known = _read(spark, log, parts, [of_job], [0]).filter((F.col("job_id") == job_id) & (F.col("position") == 0))
    if known.isEmpty():  # not indexed yet: in the tail, or folded in just now
        state = manifest(spark, log)
        rows = _rows(spark, sorted({*tail_paths(spark, log, state), *state["folded"]})).filter(F.col("job_id") == job_id)
        page = _created(rows).orderBy("created_at", "id").offset(start).limit(end - start)
        found = page.withColumn("position", F.row_number().over(Window.orderBy("created_at", "id")) + (start - 1))  # a page's rows
    else:
        found = _read(spark, log, parts, [of_job], list(range(start // CHUNK, (end - 1) // CHUNK + 1))).filter(F.col("job_id") == job_id)
    return found.filter(F.col("position").between(start, end - 1)).select("position", "id")


def results_page(spark: SparkSession, log: str, job_id: str, page: str | None = None, limit: str | None = None, include_text: bool = False) -> DataFrame:
    """The rows of jobs.results_page, in order, as the log has them now. Unknown jobs and pages past the end have none."""
    _, size, offset = jobs.page_arguments(page, limit)
    here = [(r["position"], r["id"]) for r in places(spark, log, job_id, offset, offset + size).collect()]  # a page: 20 rows at most
    wanted = F.broadcast(spark.createDataFrame(here, "position bigint, id string"))
    items = jobs.latest_items(read_log(spark, log, wanted))
    return items.join(wanted, "id").orderBy("position").select(*jobs.RESULT_COLUMNS, *["text"] * include_text)
