"""Queue consumer: messages in JSON files or any stream of MESSAGE rows, states in append-only logs.

Each micro-batch writes the partition batch_id=N of the log and nothing else, so a replayed
batch overwrites what it wrote before; messages of finished items are skipped, so that
at-least-once delivery leaves one end state. A submission writes a partition for each of its
jobs, so no other job's rows are touched and the same submission may be sent again. Of the log a
batch reads the narrow columns of its own items; retries that aren't due go back to the queue.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import retry_delay_seconds
from textloom.operators import jobs
from textloom.schemas import ITEM_LOG, JOB_LOG, MESSAGE
from textloom.streaming.store import read_log

MAX_FILES, WAIT = 5, "2 seconds"
PHASES = {"created": 0, "processing": 1, "result": 2, "retry": 2, "dead": 2}


def _transitions(rows: DataFrame, batch_id: int) -> DataFrame:
    """ITEM_LOG rows. seq orders transitions: batch, then phase. batch_id -1 is for rows made outside the stream."""
    phase = F.create_map(*[x for k, v in PHASES.items() for x in (F.lit(k), F.lit(v))])
    out = rows.withColumn("seq", F.lit((batch_id + 1) * 10) + phase[F.col("kind")])
    return out.select(*[F.col(f.name).cast(f.dataType) for f in ITEM_LOG.fields])


def write_log(rows: DataFrame, path: str, batch_id: int) -> None:
    _transitions(rows, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def job_log(log: str) -> str:
    """The folder of the jobs' own log beside that of their items."""
    return log.rstrip("/") + "_jobs"


def read_jobs(spark: SparkSession, log: str) -> DataFrame:
    """JOB_LOG rows: a job created, or its messages lost."""
    return spark.read.schema(JOB_LOG).option("recursiveFileLookup", "true").parquet(job_log(log))


def _by_job(rows: DataFrame, job: str, path: str) -> None:
    """Overwrites the partitions of the jobs in rows and no others."""
    rows.withColumn("job", F.col(job)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job").parquet(path)


def submit(items: DataFrame, log: str, queue: str, send: Callable[[DataFrame, str], None] | None = None) -> None:
    """Logs new jobs and their items as created and sends one message an item.

    If sending fails, items and jobs are logged as failed with the reason, and the error goes on.
    """
    rows = items.withColumnRenamed("created_at", "_at").select("id", "job_id", "url", *jobs.transition("created", "queued", ts=F.col("_at")))
    made = jobs.created_jobs(items)
    _by_job(_transitions(rows, -1), "job_id", f"{log}/created")
    _by_job(made, "id", f"{job_log(log)}/created")
    try:
        (send or (lambda m, to: m.write.mode("append").json(to)))(jobs.messages(items), queue)
    except Exception as e:
        now, reason = jobs.iso(F.current_timestamp()), str(e) or type(e).__name__
        lost = items.select("id", "job_id", "url", *jobs.transition("dead", "failed", error=F.lit(jobs.ENQUEUE_FAILED + reason), ts=now))
        _by_job(_transitions(lost, -1), "job_id", f"{log}/enqueue_failed")
        _by_job(jobs.lost_jobs(made, reason, now), "id", f"{job_log(log)}/enqueue_failed")
        raise


def accept(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Valid messages of known, unfinished items, one per item: inner join, terminal items left out."""
    valid = batch.filter(jobs.valid_message(F.struct(*batch.columns)))
    attempts = valid.groupBy("itemId").agg(F.max(F.coalesce("attempts", F.lit(1))).alias("attempts"))
    known = items.filter(~F.col("status").isin(jobs.TERMINAL)).select(F.col("id").alias("itemId"), "job_id", "url")
    return attempts.join(known, "itemId").withColumnRenamed("itemId", "id")


def outcomes(accepted: DataFrame, results: DataFrame) -> DataFrame:
    """Log rows from results (id, success, method, title, text, text_length, final_url, duration_ms, error, raised).

    raised: an exception, to be retried or at the last attempt final; an unsuccessful result is final.
    """
    j = accepted.join(results, "id")
    last = F.col("attempts") >= jobs.MAX_ATTEMPTS
    r = F.col("raised")
    kind = F.when(~r, "result").when(last, "dead").otherwise("retry")
    status = F.when(~r, F.when(F.col("success"), "completed").otherwise("failed")).when(last, "failed").otherwise("queued")
    keep = lambda c: F.when(~r, F.col(c))
    return j.select(
        "id", "job_id", "url", "attempts", kind.alias("kind"), status.alias("status"),
        *[keep(c).alias(c) for c in jobs.RESULT_FIELDS], F.col("error"), jobs.iso(F.current_timestamp()).alias("ts"),
    )


def now_ms() -> int:
    return int(time.time() * 1000)


def process_batch(batch: DataFrame, batch_id: int, log: str, queue: str, dead: str, work: Callable[[DataFrame], DataFrame], clock: Callable[[], int] = now_ms) -> None:
    """work: rows (id, job_id, url) to results as in outcomes(). clock: milliseconds since 1970."""
    spark = batch.sparkSession
    due = F.coalesce(F.col("not_before") <= clock(), F.lit(True))
    batch.filter(~due).write.mode("overwrite").json(f"{queue}/held-{batch_id}")
    batch = batch.filter(due)
    asked = batch.select(F.col("itemId").alias("id")).distinct()
    earlier = read_log(spark, log, asked).filter(F.col("seq") < (batch_id + 1) * 10)
    accepted = accept(batch, jobs.latest_items(earlier)).persist()
    started = accepted.select("id", "job_id", "url", *jobs.transition("processing", "processing", ts=jobs.iso(F.current_timestamp())))
    ended = outcomes(accepted, work(accepted)).persist()
    write_log(started.unionByName(ended.drop("attempts")), log, batch_id)
    again = ended.filter("kind = 'retry'").select(
        F.lit("scrape_url").alias("type"), F.col("job_id").alias("jobId"), F.col("id").alias("itemId"), "url",
        (F.col("attempts") + 1).alias("attempts"), (F.lit(clock()) + 1000 * retry_delay_seconds(F.col("attempts"))).alias("not_before"),
    )
    again.write.mode("overwrite").json(f"{queue}/retry-{batch_id}")
    ended.filter("kind = 'dead'").write.mode("overwrite").json(f"{dead}/batch_id={batch_id}")
    accepted.unpersist()
    ended.unpersist()


def consume(
    spark: SparkSession, log: str, queue: str, dead: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], once: bool = False,
    clock: Callable[[], int] = now_ms,
) -> StreamingQuery:
    """The offset commit is the acknowledgement. once: all that is there, then stop; retries that aren't due stay in the queue."""
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", MAX_FILES).option("recursiveFileLookup", "true").json(queue)
    writer = stream.writeStream.foreachBatch(lambda b, n: process_batch(b, n, log, queue, dead, work, clock)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=WAIT)).start()
