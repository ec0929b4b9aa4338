"""Jobs over append-only logs: item and job states are views, never updated in place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import pad_number

MAX_ATTEMPTS = 3
ENQUEUE_FAILED = "Queue gönderimi başarısız: "
TERMINAL = ["completed", "failed"]


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def created_jobs(items: DataFrame) -> DataFrame:
    """The JOB_LOG row of each job of new items (create_job)."""
    jobs = items.groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("total"), F.min("created_at").alias("ts"))
    return jobs.select("id", F.lit(0).cast("bigint").alias("seq"), F.lit("created").alias("kind"), "total", F.lit(None).cast("string").alias("error"), "ts")


def lost_jobs(created: DataFrame, message: str, now: Column) -> DataFrame:
    """The JOB_LOG rows that follow those of created if their messages couldn't be sent."""
    return created.withColumns({"seq": F.lit(1).cast("bigint"), "kind": F.lit("enqueue_failed"), "error": F.lit(ENQUEUE_FAILED + message), "ts": now})


def create_job(urls: DataFrame, job_id: Column, item_suffix: Column, now: Column) -> DataFrame:
    """Item rows of one job per row of urls (job key, urls array); every row shares `now`."""
    rows = urls.select(job_id.alias("job_id"), F.posexplode("urls").alias("_p", "url"))
    item = F.concat(F.lit("item_"), pad_number(F.col("_p") + 1, 3), F.lit("_"), item_suffix)
    return rows.select(item.alias("id"), "job_id", "url", F.lit("queued").alias("status"), now.alias("created_at"), now.alias("updated_at"))


def messages(items: DataFrame) -> DataFrame:
    return items.select(
        F.lit("scrape_url").alias("type"), F.col("job_id").alias("jobId"), F.col("id").alias("itemId"), "url", F.lit(1).alias("attempts")
    )


def valid_message(m: Column) -> Column:
    full = [F.coalesce(m[k].cast("string"), F.lit("")) != "" for k in ("jobId", "itemId", "url")]
    return F.coalesce((m["type"] == "scrape_url") & full[0] & full[1] & full[2], F.lit(False))


RESULT_FIELDS = ["method", "title", "text", "text_length", "final_url", "duration_ms"]


def latest_items(log: DataFrame) -> DataFrame:
    """The state of each item: status, error and time of the last transition, columns of the last result.

    A permanent failure and a retry leave earlier result columns as they are, so the state
    merges by column. max_by combines map-side: no window over a hot item's history.
    """
    fields = F.struct(*RESULT_FIELDS)
    state = log.groupBy("id").agg(
        F.max_by(F.struct("status", "error", "ts"), "seq").alias("s"),
        F.max_by(F.when(F.col("kind") == "result", fields), F.when(F.col("kind") == "result", F.col("seq"))).alias("r"),
        F.min_by(F.struct("job_id", "url", F.col("ts").alias("created_at")), "seq").alias("c"),
    )
    r = {k: F.col("r")[k] for k in RESULT_FIELDS}
    number = {k: F.coalesce(r[k], F.lit(0)) for k in ("text_length", "duration_ms")}
    text = {k: F.nullif(r[k], F.lit("")) for k in ("method", "title", "text", "final_url")}
    return state.select(
        "id", F.col("c.job_id").alias("job_id"), F.col("c.url").alias("url"), F.col("s.status").alias("status"),
        *[text[k].alias(k) for k in ("method", "title", "text")], number["text_length"].alias("text_length"),
        text["final_url"].alias("final_url"), F.nullif(F.col("s.error"), F.lit("")).alias("error"),
        number["duration_ms"].alias("duration_ms"), F.col("c.created_at").alias("created_at"), F.col("s.ts").alias("updated_at"),
    )


def transition(kind: str, status: str | Column, **columns: Column) -> list[Column]:
    """Columns of a log row besides id, job_id, url and seq; names not given are null."""
    types = dict(method="string", title="string", text="string", text_length="bigint", final_url="string", error="string", duration_ms="bigint", ts="string")
    shown = status if isinstance(status, Column) else F.lit(status)
    return [F.lit(kind).alias("kind"), shown.alias("status")] + [columns.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()]


def rollup(items: DataFrame) -> DataFrame:
    """Counters of every job at once; partial counts combine before the shuffle."""
    s = F.col("status")
    times = [F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")] if {"created_at", "updated_at"} <= set(items.columns) else []
    return items.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.count_if(s.isin(TERMINAL)).alias("completed"),
        F.count_if(s == "completed").alias("successful"),
        F.count_if(s == "failed").alias("failed"),
        *times,
    )


def job_status(total: Column, completed: Column, failed: Column) -> Column:
    return (
        F.when((completed >= total) & (total > 0), F.when(failed > 0, "completed_with_errors").otherwise("completed"))
        .when(completed == 0, "queued")
        .otherwise("processing")
    )


def pending(total: Column, completed: Column) -> Column:
    return F.greatest(F.lit(0), total - completed)


def progress(total: Column, completed: Column) -> Column:
    return F.when(total > 0, F.floor(completed / total * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint")


def job_view(items: DataFrame, job_log: DataFrame | None = None) -> DataFrame:
    """Jobs with status, pending and progress; an enqueue failure in job_log overrides the counters.

    With the times of items, a job's too: created with its first item, updated with the last change of any.
    """
    jobs = rollup(items)
    times = [c for c in ("created_at", "updated_at") if c in jobs.columns]
    if job_log is not None:
        at = [F.max("ts").alias("_at")] if times else []
        lost = job_log.filter("kind = 'enqueue_failed'").groupBy(F.col("id").alias("job_id")).agg(F.lit(True).alias("_lost"), *at)
        jobs = jobs.join(lost, "job_id", "left")
        if times:
            jobs = jobs.withColumn("updated_at", F.greatest("updated_at", "_at"))
    else:
        jobs = jobs.withColumn("_lost", F.lit(None).cast("boolean"))
    lost, total = F.coalesce(F.col("_lost"), F.lit(False)), F.col("total")
    done, failed = F.when(lost, total).otherwise(F.col("completed")), F.when(lost, total).otherwise(F.col("failed"))
    status = F.when(lost, "failed").otherwise(job_status(total, done, failed))
    return jobs.select(
        "job_id", status.alias("status"), "total", done.alias("completed"),
        F.when(lost, 0).otherwise(F.col("successful")).alias("successful"), failed.alias("failed"),
        pending(total, done).alias("pending"), progress(total, done).alias("progress"), *times,
    )


def enqueue_failed(items: DataFrame, job_id: str, message: str, now: Column) -> DataFrame:
    """Every item of the job as failed."""
    return items.withColumns({
        "error": F.when(F.col("job_id") == job_id, ENQUEUE_FAILED + message).otherwise(F.col("error")),
        "status": F.when(F.col("job_id") == job_id, "failed").otherwise(F.col("status")),
        "updated_at": F.when(F.col("job_id") == job_id, now).otherwise(F.col("updated_at")),
    })


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id).limit(1)


def get_item(items: DataFrame, item_id: str) -> DataFrame:
    return items.filter(F.col("id") == item_id).drop("text").limit(1)


def _js_number(text: str | None) -> float:
    """A query parameter as ECMAScript's Number() reads it; an absent one is 0-like (not finite here)."""
    t = (text or "").strip()
    if not t:
        return math.nan
    for prefix, base in (("0x", 16), ("0o", 8), ("0b", 2)):
        if t[:2].lower() == prefix:
            try:
                return float(int(t[2:], base)) if "_" not in t else math.nan
            except ValueError:
                return math.nan
    body = t[1:] if t[0] in "+-" else t
    if body == "Infinity":
        return -math.inf if t[0] == "-" else math.inf
    if not all(c in "0123456789.eE+-" for c in t):
        return math.nan
    try:
        return float(t)
    except ValueError:
        return math.nan


def page_arguments(page: str | None, limit: str | None) -> tuple[int, int, int]:
    """(page, limit, offset) with the clamps: page from 1, limit 1 to 20, 10 if it isn't a number."""
    p, n = _js_number(page), _js_number(limit)
    number = max(1, math.floor(p)) if math.isfinite(p) else 1
    size = min(20, max(1, math.floor(n))) if math.isfinite(n) else 10
    return number, size, (number - 1) * size


RESULT_COLUMNS = ["id", "url", "status", "method", "title", "text_length", "final_url", "error", "duration_ms", "created_at", "updated_at"]


def results_page(items: DataFrame, job_id: str, page: str | None = None, limit: str | None = None, include_text: bool = False) -> DataFrame:
    """One page of a job's items. All of a job share created_at, so id breaks the ties."""
    _, size, offset = page_arguments(page, limit)
    rows = items.filter(F.col("job_id") == job_id).select(*RESULT_COLUMNS, *["text"] * include_text)
    return rows.orderBy("created_at", "id").offset(offset).limit(size)


def retry_plan(attempts: Column, delay: Column) -> Column:
    """struct<action, delay_s>: fail at the last attempt, else retry after the delay."""
    last = attempts >= MAX_ATTEMPTS
    return F.struct(F.when(last, "fail").otherwise("retry").alias("action"), F.when(~last, delay).alias("delay_s"))
