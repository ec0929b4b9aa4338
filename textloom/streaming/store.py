"""The items' log as a store: a snapshot by bucket of item id, and the tail that came since.

    <log>/_manifest/<version>.json      through: the last batch folded in; buckets: bucket to version; folded: files of submissions
    <log>/_snapshot/v=<version>/bucket=<b>/    log rows, at most three an item
    <log>/batch_id=<n>/..., created/..., enqueue_failed/...    the tail
    <log>/_work/batch_id=<n>/...        what the worker keeps between its phases

The state of an item is a merge of its log rows (jobs.latest_items) in which only its first row, its last and
its last result count. Compaction keeps these and rewrites only the buckets that the tail touches; a
manifest, a new file each time, makes it take effect at once. What a compaction folded in is deleted by the
one after it, so a reader that began before has its files for that long. To find the items of a batch, their
buckets' files are read and the tail, not the log.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.schemas import ITEM_LOG

BUCKETS = 64
#: Batches after which the consumer folds the tail in.
COMPACT_EVERY = 100
#: Ids that are pushed down to the files as a list; more are joined.
PUSHED_IDS = 500


class Files:
    """Hadoop's view of files, as Spark has it: any store that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def children(self, path: str) -> list[str]:
        store, p = self._at(path)
        return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []

    def below(self, path: str) -> list[str]:
        """Paths of all data files."""
        store, p = self._at(path)
        out, each = [], store.listFiles(p, True) if store.exists(p) else None
        while each is not None and each.hasNext():
            f = each.next().getPath()
            if not f.getName().startswith(("_", ".")):
                out.append(f.toString())
        return sorted(out)

    def delete(self, path: str) -> None:
        store, p = self._at(path)
        store.delete(p, True)

    def read(self, path: str) -> str:
        store, p = self._at(path)
        stream = store.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """A new file; an error if it is there."""
        store, p = self._at(path)
        stream = store.create(p, False)
        stream.write(bytearray(text.encode()))
        stream.close()


def bucket_of(item: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, log: str) -> dict:
    """The one in force: version, through (a batch), buckets (to the version that has them), folded (files)."""
    files = Files(spark)
    names = [n for n in files.children(f"{log}/_manifest") if n.endswith(".json")]
    return json.loads(files.read(f"{log}/_manifest/{names[-1]}")) if names else {"version": 0, "through": -1, "buckets": {}, "folded": []}


def _rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], ITEM_LOG)
    return spark.read.schema(ITEM_LOG).option("recursiveFileLookup", "true").parquet(*paths)


def _batch(name: str) -> int | None:
    return int(name.removeprefix("batch_id=")) if name.startswith("batch_id=") else None


def tail_paths(spark: SparkSession, log: str, state: dict) -> list[str]:
    """What isn't in the snapshot: folders of later batches, files of submissions that aren't folded in."""
    files, folded = Files(spark), set(state["folded"])
    names = [n for n in files.children(log) if not n.startswith(("_", "."))]
    later = [f"{log}/{n}" for n in names if _batch(n) is not None and _batch(n) > state["through"]]
    return later + [f for n in names if _batch(n) is None for f in files.below(f"{log}/{n}") if f not in folded]


def snapshot_paths(log: str, state: dict, buckets: list[int] | None = None) -> list[str]:
    wanted = None if buckets is None else {str(b) for b in buckets}
    return [f"{log}/_snapshot/v={v}/bucket={b}" for b, v in sorted(state["buckets"].items()) if wanted is None or b in wanted]


def read_log(spark: SparkSession, log: str, ids: DataFrame | None = None) -> DataFrame:
    """ITEM_LOG rows: all, or those of the items in ids (id), from the buckets' files that may have them and from the tail.

    ids is a batch's: its buckets, and its ids if they are few, are collected to choose files.
    """
    state = manifest(spark, log)
    if ids is None:
        return _rows(spark, snapshot_paths(log, state)).unionByName(_rows(spark, tail_paths(spark, log, state)))
    ids = ids.select("id").distinct()
    buckets = [r[0] for r in ids.select(bucket_of(F.col("id"))).distinct().collect()]
    rows = _rows(spark, snapshot_paths(log, state, buckets)).unionByName(_rows(spark, tail_paths(spark, log, state)))
    few = [r[0] for r in ids.limit(PUSHED_IDS + 1).collect()]
    return rows.filter(F.col("id").isin(few)) if len(few) <= PUSHED_IDS else rows.join(ids, "id", "left_semi")


def needed(log: DataFrame) -> DataFrame:
    """Of each item the rows that its state depends on: the first, the last, the last result."""
    row = F.struct(*log.columns)
    result = F.col("kind") == "result"
    kept = log.groupBy("id").agg(
        F.min_by(row, "seq").alias("first"), F.max_by(row, "seq").alias("last"), F.max_by(F.when(result, row), F.when(result, F.col("seq"))).alias("result")
    )
    each = kept.select(F.explode(F.array_distinct(F.array_compact(F.array("first", "last", "result")))).alias("r"))
    return each.select("r.*")


def compact(spark: SparkSession, log: str, through: int) -> dict:
    """Folds the tail, as far as the batch `through` and all submissions, into the snapshot; the new manifest.

    Batches up to `through` are done: no replay will write them again. A submission that is written meanwhile is
    in files of its own, and stays in the tail.
    """
    files, state = Files(spark), manifest(spark, log)
    upto = lambda n, last: _batch(n) is not None and _batch(n) <= last
    paths = [p for p in tail_paths(spark, log, state) if _batch(name := p.rsplit("/", 1)[1]) is None or upto(name, through)]
    if not paths:
        return state
    tail = _rows(spark, paths)
    touched = [r[0] for r in tail.select(bucket_of(F.col("id"))).distinct().collect()]  # BUCKETS numbers at most
    version = state["version"] + 1
    rows = needed(_rows(spark, snapshot_paths(log, state, touched)).unionByName(tail)).withColumn("bucket", bucket_of(F.col("id")))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(8))).sortWithinPartitions("bucket", "id")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/_snapshot/v={version}")
    for f in state["folded"]:
        files.delete(f)
    submissions = [p for p in paths if _batch(p.rsplit("/", 1)[1]) is None]
    new = {"version": version, "through": max(through, state["through"]), "buckets": state["buckets"] | {str(b): version for b in touched}, "folded": submissions}
    files.create(f"{log}/_manifest/{version:012d}.json", json.dumps(new))
    for top in (log, f"{log}/_work"):
        for n in files.children(top):
            if upto(n, state["through"]):
                files.delete(f"{top}/{n}")
    _vacuum(files, log, new)
    return new


def _vacuum(files: Files, log: str, state: dict) -> None:
    """Deletes buckets that neither this manifest nor the one before has: a reader that began before is done by then."""
    names = [n for n in files.children(f"{log}/_manifest") if n.endswith(".json")]
    used = {f"v={v}/bucket={b}" for n in names[-2:] for b, v in json.loads(files.read(f"{log}/_manifest/{n}"))["buckets"].items()}
    for v in files.children(f"{log}/_snapshot"):
        if v == f"v={state['version']}":
            continue
        for b in files.children(f"{log}/_snapshot/{v}"):
            if f"{v}/{b}" not in used and b.startswith("bucket="):
                files.delete(f"{log}/_snapshot/{v}/{b}")
    for n in names[:-2]:
        files.delete(f"{log}/_manifest/{n}")
