"""The web as a batch data source: what a filter leaves out is never fetched.

Requests are written once as Parquet, dealt to folders by host (`write_requests`); the source plans a partition
for each folder, from their names alone, and its tasks read their own files. So one host is asked by at most
`per_host` tasks, `concurrency` requests at a time each, however many executors there are, and a host with a third of
all URLs is spread over that many tasks rather than one.

    write_requests(requests, folder)
    spark.dataSource.register(WebSource)
    spark.read.format("textloom_web").option("path", folder).load().filter("host = 'example.org'")

Filters on pos, url and host (=, <=>, IN, comparisons, prefix, suffix, part, IS [NOT] NULL, and NOT of these) are applied to the
requests; = and IN on host choose folders too. Spark takes a source that filters only where
spark.sql.python.filterPushdown.enabled is true, which `reading` sets; elsewhere it's an error.

With `rendered` as the option `kind` rows are RENDERED instead of FETCHED; then `opener` names what opens a URL
(`module:callable`, as for sources.pages.renderer). A failure is a row with its message. Requests without a URL are left out.
"""

from __future__ import annotations

import importlib
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.urls import host_of
from textloom.schemas import FETCHED, RENDERED
from textloom.sources.pages import FETCH_CONCURRENCY, RENDER_CONCURRENCY, ROWS_AT_ONCE
from textloom.sources.queue import Folder

#: Folders of requests, and tasks that may ask one host.
BUCKETS, PER_HOST = 256, 4
REQUEST = ("pos", "url", "host")


def bucket_of(host: str, lane: int, buckets: int) -> int:
    return (zlib.crc32(host.encode()) + lane) % buckets


def write_requests(requests: DataFrame, path: str, buckets: int = BUCKETS, per_host: int = PER_HOST) -> None:
    """requests (pos, url) as folders `lanes=<per_host>/of=<buckets>/bucket=<n>`, by host and one of its lanes.

    A folder has the rows of its hosts side by side. The path must be new or empty. Null URLs aren't written.
    """
    rows = requests.filter("url IS NOT NULL").select("pos", "url", F.lower(host_of(F.col("url"))).alias("host"))
    lane = F.pmod(F.xxhash64("pos", "url"), F.lit(per_host))
    bucket = F.pmod(F.crc32(F.encode("host", "UTF-8")) + lane, F.lit(buckets)).cast("int")
    dealt = rows.withColumns({"lanes": F.lit(per_host), "of": F.lit(buckets), "bucket": bucket})
    spread = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "host", "pos")
    spread.write.partitionBy("lanes", "of", "bucket").mode("error").parquet(path)


def _simple(f: ds.Filter) -> bool:
    if isinstance(f, ds.Not):
        return _simple(f.child)
    kinds = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual,
             ds.StringStartsWith, ds.StringEndsWith, ds.StringContains, ds.IsNull, ds.IsNotNull)
    return isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in REQUEST


def _holds(f: ds.Filter, row: dict) -> bool | None:
    """What the filter says of a request; None where SQL says null."""
    if isinstance(f, ds.Not):
        held = _holds(f.child, row)
        return None if held is None else not held
    have = row[f.attribute[0]]
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return (have is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return have == f.value
    if have is None or f.value is None:
        return None
    match f:
        case ds.EqualTo():
            return have == f.value
        case ds.In():
            return True if have in f.value else None if None in f.value else False
        case ds.GreaterThan():
            return _order(have) > _order(f.value)
        case ds.GreaterThanOrEqual():
            return _order(have) >= _order(f.value)
        case ds.LessThan():
            return _order(have) < _order(f.value)
        case ds.LessThanOrEqual():
            return _order(have) <= _order(f.value)
        case ds.StringStartsWith():
            return have.startswith(f.value)
        case ds.StringEndsWith():
            return have.endswith(f.value)
    return f.value in have


def _order(value):
    """Texts compare by their UTF-8 bytes, as in Spark."""
    return value.encode() if isinstance(value, str) else value


def _may_hold(folder: str, hosts: list[str]) -> bool:
    lanes, buckets, bucket = (int(x.split("=")[1]) for x in folder.split("/"))
    return any(bucket == bucket_of(h, lane, buckets) for h in hosts for lane in range(lanes))


class Bucket(ds.InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class WebReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, opener: str, concurrency: int, error: str) -> None:
        self.path, self.schema, self.opener, self.concurrency, self.error = path, schema, opener, concurrency, error
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if _simple(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Bucket]:
        """A folder each; only those that a host of the filters can be in."""
        store = Folder(self.path)
        folders = sorted({"/".join(n.split("/")[:3]) for n in store.names() if n.endswith(".parquet")})
        for f in self.filters:
            if isinstance(f, ds.EqualTo | ds.In) and f.attribute == ("host",):
                hosts = [h for h in (f.value if isinstance(f, ds.In) else (f.value,)) if h is not None]
                folders = [x for x in folders if _may_hold(x, hosts)]
        return [Bucket(x) for x in folders]

    def _requests(self, folder: str) -> Iterator[dict]:
        import pyarrow.parquet as pq

        store = Folder(self.path)
        for name in sorted(store.names(folder)):
            with store.store.open_input_file(f"{store.root}/{folder}/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(ROWS_AT_ONCE, columns=list(REQUEST)):
                    yield from (r for r in batch.to_pylist() if all(_holds(x, r) is True for x in self.filters))

    def read(self, partition: Bucket | None) -> Iterator[tuple]:
        if partition is None:  # what Spark gives where no folder is left
            return
        module, _, name = self.opener.partition(":")
        one: Callable[[str], dict] = getattr(importlib.import_module(module), name)
        fields = self.schema.names

        def row(request: dict) -> tuple:
            began = time.monotonic()
            try:
                got = one(request["url"])
            except Exception as e:  # noqa: BLE001  each failure is a row
                got = {self.error: str(e) or type(e).__name__}
            made = got | request | {"duration_ms": int((time.monotonic() - began) * 1000)}
            return tuple(made.get(f) for f in fields)

        with ThreadPoolExecutor(self.concurrency) as pool:
            some: list[dict] = []
            for request in self._requests(partition.folder):
                some.append(request)
                if len(some) == ROWS_AT_ONCE:
                    yield from pool.map(row, some)
                    some = []
            yield from pool.map(row, some)


class WebSource(ds.DataSource):
    """Options: path; kind (fetched, or rendered); opener (sources.pages:http_get); concurrency (6, or 3)."""

    @classmethod
    def name(cls) -> str:
        return "textloom_web"

    def _rendered(self) -> bool:
        return self.options.get("kind", "fetched").lower() == "rendered"

    def schema(self) -> T.StructType:
        columns = (RENDERED if self._rendered() else FETCHED).fields
        return T.StructType([*columns, T.StructField("host", T.StringType())])

    def reader(self, schema: T.StructType) -> WebReader:
        rendered = self._rendered()
        if rendered and "opener" not in self.options:
            raise ValueError("rendered pages need an opener: module:callable")
        concurrency = int(self.options.get("concurrency", RENDER_CONCURRENCY if rendered else FETCH_CONCURRENCY))
        opener = self.options.get("opener", "textloom.sources.pages:http_get")
        return WebReader(self.options["path"], schema, opener, concurrency, "render_error" if rendered else "fetch_error")


def reading(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The source over a folder of requests, with filters pushed to it in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WebSource)
    return spark.read.format("textloom_web").options(path=path, **options).load()


def web_pages(spark: SparkSession, path: str, buckets: int = BUCKETS, per_host: int = PER_HOST) -> Callable[[DataFrame], DataFrame]:
    """A fetch for operators.scrape: its requests go to a folder of their own below path, and are fetched host by host."""

    def fetch(requests: DataFrame) -> DataFrame:
        folder = f"{path.rstrip('/')}/{time.time_ns()}"
        write_requests(requests, folder, buckets, per_host)
        return reading(spark, folder).select(*FETCHED.names)

    return fetch
