"""The consumer's work: the two-stage scrape of a micro-batch, committed phase by phase.

    accepted     what the batch asks for, of known and unfinished items       _work
    phase 1      these items as `processing`, before anything is fetched      log
    judged       pages fetched, and why the others need a browser             _work
    phase 2      results of pages that are done, before any browser starts    log
    rendered     pages that a browser was needed for                          _work
    phase 3      their results; errors as retries or dead letters             log, queue, dead letters

Each is written once: a batch that is run again after a crash goes on behind the last one that was committed,
fetches no page twice and overwrites nothing. If the work raises as a whole (a connector that breaks on one
message, say) the batch is halved and each half goes on from what was committed, until the message at fault is
alone; that one is retried like a page that can't be rendered, and is a dead letter at its last attempt. Its
neighbours finish in the same batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import retry_delay_seconds
from textloom.operators import jobs, scrape
from textloom.sources.queue import MAX_MESSAGES, QueueSource
from textloom.streaming.consumer import WAIT, _transitions, accept, now_ms, outcomes
from textloom.streaming.paging import index
from textloom.streaming.store import COMPACT_EVERY, Files, compact, manifest, read_log
from textloom.streaming.timers import hold

Connector = Callable[[DataFrame], DataFrame]
#: A batch's whole; its halves add 0 or 1, and so on.
WHOLE = "b"


@dataclass(frozen=True)
class Places:
    """Folders of the items' log, the queue and the dead letters."""

    log: str
    queue: str
    dead: str


class Batch:
    """One micro-batch being worked on. messages: MESSAGE rows, read once."""

    def __init__(self, messages: DataFrame, number: int, places: Places, fetch: Connector, render: Connector, clock: Callable[[], int] = now_ms) -> None:
        self.spark, self.number, self.places = messages.sparkSession, number, places
        self.fetch, self.render, self.clock, self.files = fetch, render, clock, Files(messages.sparkSession)
        self.messages = messages

    def _done(self, path: str) -> bool:
        return self.files.exists(f"{path}/_SUCCESS")

    def _once(self, path: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """What rows gives, written to path unless that was done before, and read back."""
        if not self._done(path):
            rows().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _kept(self, name: str, part: str = WHOLE) -> str:
        return f"{self.places.log}/_work/batch_id={self.number}/part={part}/{name}"

    def _logged(self, phase: int, part: str = WHOLE) -> str:
        return f"{self.places.log}/batch_id={self.number}/part={part}/phase={phase}"

    def _log(self, phase: int, part: str, rows: Callable[[], DataFrame]) -> None:
        self._once(self._logged(phase, part), lambda: _transitions(rows(), self.number))

    def _of(self, part: str, path: Callable[[str], str]) -> str | None:
        """The path of the part, or of the nearest that it is a half of, which has been written."""
        return next((p for n in range(len(part), 0, -1) if self._done(p := path(part[:n]))), None)

    def run(self) -> None:
        messages = self._once(self._kept("messages"), lambda: self.messages)

        def asked() -> DataFrame:
            ids = messages.select(F.col("itemId").alias("id"))
            earlier = read_log(self.spark, self.places.log, ids).filter(F.col("seq") < (self.number + 1) * 10)
            known = accept(messages, jobs.latest_items(earlier)).select("id", "job_id", "url", "attempts")
            return known.withColumn("pos", F.row_number().over(Window.orderBy("id")))  # a batch's ids

        accepted = self._once(self._kept("accepted"), asked)
        self._log(1, WHOLE, lambda: accepted.select("id", "job_id", "url", *jobs.transition("processing", "processing", ts=_now())))
        self._work(WHOLE, accepted)

    def _work(self, part: str, accepted: DataFrame) -> None:
        try:
            self._scrape(part, accepted)
        except Exception as e:
            if re.search("InterruptedException|cancelled", str(e)):  # the query is being stopped
                raise
            if accepted.count() < 2:
                self._end(part, lambda: self._outcomes(accepted, _failure(accepted, _reason(e))))
                return
            half = accepted.withColumn("half", F.ntile(2).over(Window.orderBy("id")) - 1)
            for n in (0, 1):
                self._work(f"{part}{n}", self._once(self._kept("accepted", f"{part}{n}"), lambda n=n: half.filter(F.col("half") == n).drop("half")))

    def _scrape(self, part: str, accepted: DataFrame) -> None:
        def judged() -> DataFrame:
            bad, wanted, skipped = scrape.admit(accepted.select("pos", "url"))
            pages = scrape.judge_fetched(self.fetch(wanted)).drop("body", "_html").unionByName(skipped, allowMissingColumns=True)
            return pages.withColumn("refused", F.lit(None).cast("string")).unionByName(bad.select("pos", F.col("requestedUrl").alias("url"), F.col("error").alias("refused")), allowMissingColumns=True)

        earlier = self._of(part, lambda p: self._kept("judged", p))
        pages = self._once(earlier or self._kept("judged", part), judged).join(accepted.select("pos"), "pos", "left_semi")
        if not self._of(part, lambda p: self._logged(2, p)):
            fast = scrape.fetch_results(pages.filter("refused IS NULL")).unionByName(scrape.refused(pages.filter("refused IS NOT NULL").select("pos", "url", F.col("refused").alias("error"))))
            self._log(2, part, lambda: self._outcomes(accepted, _results(accepted, fast, F.lit(False))))
        waiting = pages.filter("reason IS NOT NULL").select("pos", "url", "reason")
        if not waiting.isEmpty():
            rendered = self._once(self._kept("rendered", part), lambda: scrape.render_results(self.render(waiting.select("pos", "url")), waiting))
            self._end(part, lambda: self._outcomes(accepted, _results(accepted, rendered, F.col("error").isNotNull())))

    def _outcomes(self, accepted: DataFrame, results: DataFrame) -> DataFrame:
        return outcomes(accepted.drop("pos"), results)

    def _end(self, part: str, rows: Callable[[], DataFrame]) -> None:
        """Phase 3: what ended or goes back. The queue gets a retry once, with the time before which it isn't due."""
        ended = self._once(self._kept("ended", part), rows)
        self._log(3, part, lambda: ended.drop("attempts"))
        again = ended.filter("kind = 'retry'").select(
            F.lit("scrape_url").alias("type"), F.col("job_id").alias("jobId"), F.col("id").alias("itemId"), "url",
            (F.col("attempts") + 1).alias("attempts"), (F.lit(self.clock()) + 1000 * retry_delay_seconds(F.col("attempts"))).alias("not_before"),
        )
        for rows_, path in ((again, f"{self.places.queue}/retry-{self.number}-{part}"), (ended.filter("kind = 'dead'"), f"{self.places.dead}/batch_id={self.number}/part={part}")):
            if not self._done(path) and not rows_.isEmpty():
                rows_.write.mode("overwrite").json(path)


def _now() -> Column:
    return jobs.iso(F.current_timestamp())


def _results(accepted: DataFrame, rows: DataFrame, raised: Column) -> DataFrame:
    """RESULT rows by item, as outcomes() takes them."""
    r = rows.select(
        "pos", "success", "method", "title", "text", F.col("textLength").alias("text_length"), F.col("finalUrl").alias("final_url"),
        F.col("durationMs").alias("duration_ms"), "error", raised.alias("raised"),
    )
    return accepted.select("id", "pos").join(r, "pos").drop("pos")


def _failure(accepted: DataFrame, reason: str) -> DataFrame:
    none = {c: F.lit(None).cast(t) for c, t in dict(method="string", title="string", text="string", text_length="bigint", final_url="string", duration_ms="bigint").items()}
    return accepted.select("id", F.lit(False).alias("success"), *[v.alias(c) for c, v in none.items()], F.lit(reason).alias("error"), F.lit(True).alias("raised"))


def _reason(e: Exception) -> str:
    """The innermost error that the text of a failed job names."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    named = [x for x in lines if re.match(r"[\w.]*(Error|Exception)\b: ", x) and "spark" not in x.split(":")[0].lower()]
    return (named or lines or [type(e).__name__])[-1 if named else 0][:500]


def serve(
    spark: SparkSession, places: Places, checkpoint: str, fetch: Connector, render: Connector, max_messages: int = MAX_MESSAGES,
    every: int = COMPACT_EVERY, wait: str = WAIT, clock: Callable[[], int] = now_ms,
) -> StreamingQuery:
    """The whole consumer: messages by number, held until they are due, worked on phase by phase, the log compacted on the way.

    Retries that aren't due wait in the state store with a timer. Each `every` batches, those before are folded into the
    snapshot and their jobs' items get positions. The session's state store becomes RocksDB, which timers need.
    """
    spark.dataSource.register(QueueSource)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    messages = spark.readStream.format("textloom_queue").option("path", places.queue).option("max_messages", max_messages).load()
    due = hold(messages.filter(jobs.valid_message(F.struct(*messages.columns))))

    def work(batch: DataFrame, number: int) -> None:
        Batch(batch, number, places, fetch, render, clock).run()
        session = batch.sparkSession
        if number - manifest(session, places.log)["through"] > every:  # this batch may yet be run again, those before not
            index(session, places.log)  # of the compaction before, if a crash came between
            compact(session, places.log, number - 1)
            index(session, places.log)

    return due.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=wait).start()
