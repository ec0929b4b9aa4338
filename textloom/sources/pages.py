"""Page connectors. Everything after the body is column expressions, so a connector only fetches.

A connector maps (pos, url) to FETCHED or RENDERED rows and turns each failure into a row of
its own: one bad URL never fails its neighbours. Each task has a pool of `concurrency` threads, and
there are as many tasks as the cluster has cores (or `partitions`), so more machines fetch more.
"""

from __future__ import annotations

import contextlib
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.schemas import FETCHED, RENDERED

FETCH_CONCURRENCY, RENDER_CONCURRENCY = 6, 3
FETCH_TIMEOUT_S, RENDER_TIMEOUT_S = 15, 30
#: Rows whose bodies a task holds at a time.
ROWS_AT_ONCE = 60

#: Request headers that decide what a server sends.
ACCEPT = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ACCEPT_LANGUAGE = "tr-TR,tr;q=0.9,en;q=0.8"
USER_AGENT = "Mozilla/5.0 (compatible; textloom)"


def _stored(rows: DataFrame) -> tuple[str, DataFrame]:
    """(key, rows with one for each key), so that a request gets one row. With a pos, rows belong to requests, whose URLs
    may repeat; of several that are stored under one key, the greatest is taken, whatever their order."""
    key = "pos" if "pos" in rows.columns else "url"
    rest = [c for c in rows.columns if c not in ("pos", "url")]
    return key, rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(key, "_row.*")


def _fields(schema) -> list[Column]:
    """A schema's columns; pos keeps its type."""
    return [F.col(f.name) if f.name == "pos" else F.col(f.name).cast(f.dataType) for f in schema.fields]


def stored_pages(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Offline fetch: bodies come from a table (url or pos, html, optional http_status and content_type)."""

    def col(name, default):
        return F.col(name) if name in pages.columns else default

    key, stored = _stored(pages.select(
        *[c for c in ("pos", "url") if c in pages.columns], col("http_status", F.lit(200)).cast("int").alias("http_status"),
        col("content_type", F.lit("text/html; charset=utf-8")).alias("content_type"),
        F.encode("html", "UTF-8").alias("body"),
    ))

    def fetch(requests: DataFrame) -> DataFrame:
        rows = requests.join(stored, key, "left").withColumns({
            "final_url": F.col("url"),
            "fetch_error": F.when(F.col("http_status").isNull(), F.lit("not stored")),
            "duration_ms": F.lit(0),
        })
        return rows.select(*_fields(FETCHED))

    return fetch


def http_get(url: str) -> dict:
    """The response after redirects, whatever its status: 404 and 503 have a body and a type like any other."""
    headers = {"Accept": ACCEPT, "Accept-Language": ACCEPT_LANGUAGE, "User-Agent": USER_AGENT}
    try:
        response = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=FETCH_TIMEOUT_S)
    except urllib.error.HTTPError as e:
        response = e
    with response as r:
        return {"http_status": r.status, "content_type": r.headers.get("Content-Type"), "final_url": r.url, "body": r.read()}


Fetch = Callable[[str], dict]


def _mapped(df: DataFrame, schema, error: str, session: Callable[[], contextlib.AbstractContextManager[Fetch]], concurrency: int, partitions: int | None) -> DataFrame:
    """session: entered once by each task that has rows, closed when it ends; what it gives opens one URL."""
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with contextlib.ExitStack() as stack:
            one = pool = None
            for b in batches:
                if len(b) and pool is None:
                    one, pool = stack.enter_context(session()), stack.enter_context(ThreadPoolExecutor(concurrency))

                def row(pos: int, url: str) -> dict:
                    began = time.monotonic()
                    try:
                        got = one(url)
                    except Exception as e:  # noqa: BLE001  each failure is a row
                        got = {error: str(e) or type(e).__name__}
                    return dict.fromkeys(names) | got | {"pos": pos, "url": url, "duration_ms": int((time.monotonic() - began) * 1000)}

                for at in range(0, len(b), ROWS_AT_ONCE):
                    part = b.iloc[at : at + ROWS_AT_ONCE]
                    yield pd.DataFrame(list(pool.map(row, part["pos"], part["url"])), columns=names)

    tasks = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.select("pos", "url").repartition(tasks).mapInPandas(run, schema)


def fetcher(one: Fetch = http_get, concurrency: int = FETCH_CONCURRENCY, partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Online fetch: `concurrency` URLs at a time in each task."""
    return lambda df: _mapped(df, FETCHED, "fetch_error", lambda: contextlib.nullcontext(one), concurrency, partitions)


def renderer(one: Fetch, concurrency: int = RENDER_CONCURRENCY, partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """one: opens a page in a browser; empty partitions never call it."""
    return lambda df: _mapped(df, RENDERED, "render_error", lambda: contextlib.nullcontext(one), concurrency, partitions)


@dataclass(frozen=True)
class PageSettings:
    """What a page is opened with, and how long to wait for it. Times in seconds."""

    user_agent: str = "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36"
    headers: dict = field(default_factory=lambda: {"Accept-Language": ACCEPT_LANGUAGE})
    width: int = 1440
    height: int = 1200
    timeout: float = RENDER_TIMEOUT_S
    #: Special sites: until the text is longer than this and has no loading mark, then on after a pause.
    special_text: int = 1000
    special_wait: float = 15
    special_pause: float = 5
    #: Others: until the network has been idle so long.
    idle: float = 1
    idle_wait: float = 10
    idle_pause: float = 1.5


LOADING = "Loading..."


def open_page(page, url: str, special: bool = False, settings: PageSettings = PageSettings(), pause: Callable[[float], None] = time.sleep) -> dict:
    """A RENDERED row's fields from a browser's page, which is always closed.

    page: configure(settings), goto(url, timeout) -> status or None, wait_until(test of the text, timeout),
    wait_idle(idle, timeout), url(), title(), text(), close(). The waits raise when they time out,
    which isn't an error: the page is read as it is after a pause.
    """
    try:
        page.configure(settings)
        status = page.goto(url, settings.timeout)
        try:
            if special:
                page.wait_until(lambda text: LOADING not in text and len(text) > settings.special_text, settings.special_wait)
            else:
                page.wait_idle(settings.idle, settings.idle_wait)
        except Exception:  # noqa: BLE001
            pause(settings.special_pause if special else settings.idle_pause)
        return {"http_status": status, "final_url": page.url(), "raw_title": page.title(), "raw_text": page.text()}
    finally:
        with contextlib.suppress(Exception):
            page.close()


def launched(launch: Callable[[], object], concurrency: int = RENDER_CONCURRENCY, partitions: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """As renderer, with one browser for each task that has rows, closed when the task ends.

    launch: gives a callable that opens a URL, with a close() if there is something to close. A failed
    launch is every row's error.
    """

    @contextlib.contextmanager
    def session() -> Iterator[Fetch]:
        try:
            browser = launch()
        except Exception as e:  # noqa: BLE001
            reason = str(e) or type(e).__name__

            def fail(url: str) -> dict:
                raise RuntimeError(reason)

            yield fail
            return
        try:
            yield browser
        finally:
            with contextlib.suppress(Exception):
                getattr(browser, "close", lambda: None)()

    return lambda df: _mapped(df, RENDERED, "render_error", session, concurrency, partitions)


def stored_renders(renders: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Offline render: rows of a table (url or pos, raw_title, raw_text, optional http_status)."""
    key, stored = _stored(renders)

    def render(requests: DataFrame) -> DataFrame:
        rows = requests.select("pos", "url").join(stored, key, "left")
        extra = {
            "final_url": F.col("url"), "duration_ms": F.lit(0),
            "render_error": F.when(F.col("raw_text").isNull(), F.lit("not stored")),
        }
        if "http_status" not in renders.columns:
            extra["http_status"] = F.lit(200)
        return rows.withColumns(extra).select(*_fields(RENDERED))

    return render
