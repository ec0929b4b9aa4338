"""Item states kept in the state store, the changes that log rows make to them, and job counters from those changes.

Two queries: one keeps each item's status and passes on its changes (old status, new status), one adds
the changes up by job, +1 for what an item becomes and -1 for what it was. Neither reads the log again. Log rows may come
twice or late: the state remembers the last row's seq, and earlier ones change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from textloom.operators import jobs

STATE = "seq bigint, job_id string, status string"
CHANGE = "id string, job_id string, was string, status string, seq bigint"
COUNTERS = ("total", "completed", "successful", "failed")


class ItemStates(StatefulProcessor):
    """expire_ms: how long after its last change an item is remembered; None: always."""

    def __init__(self, expire_ms: int | None = None) -> None:
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("item", STATE, self.expire_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r.seq)
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[0] >= last.seq:
            return
        job = old[1] if old is not None else last.job_id  # an item stays with the job it was created for
        self.state.update((last.seq, job, last.status))
        if old is None or old[2] != last.status:
            yield Row(id=key[0], job_id=job, was=None if old is None else old[2], status=last.status, seq=last.seq)


def status_changes(log: DataFrame, expire_ms: int | None = None) -> DataFrame:
    """A stream of log rows (id, job_id, seq, status) as CHANGE rows, one an item and micro-batch at most."""
    session = log.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = log.select("id", F.col("job_id").cast("string"), F.col("seq").cast("bigint"), "status")
    mode = "None" if expire_ms is None else "ProcessingTime"
    return rows.groupBy("id").transformWithState(statefulProcessor=ItemStates(expire_ms), outputStructType=CHANGE, outputMode="Update", timeMode=mode)


def _moved(test: Callable[[Column], Column]) -> Column:
    is_, was = (F.coalesce(test(F.col(c)).cast("int"), F.lit(0)) for c in ("status", "was"))
    return is_ - was


def counter_changes(changes: DataFrame) -> DataFrame:
    """CHANGE rows as what each adds to its job's counters."""
    return changes.select(
        "job_id", F.col("was").isNull().cast("int").alias("total"), _moved(lambda s: s.isin(jobs.TERMINAL)).alias("completed"),
        _moved(lambda s: s == "completed").alias("successful"), _moved(lambda s: s == "failed").alias("failed"),
    )


def counters(changes: DataFrame) -> DataFrame:
    """job_id and the counters of jobs.rollup, added up; of a stream, in update mode, the jobs that changed."""
    return counter_changes(changes).groupBy("job_id").agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])


def keep_changes(log: DataFrame, path: str, checkpoint: str, expire_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Appends the changes to a folder of Parquet, a partition a batch, which a replay overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    conf, key = log.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    writer = status_changes(log, expire_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if not once:
        return writer.start()
    before = conf.get(key)
    conf.set(key, "false")  # a query with state that expires would go on with empty batches; it takes its settings as it starts
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def keep_counters(changes: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """upsert gets the counters of the jobs that changed in each batch."""
    writer = counters(changes).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
