"""The two-stage pipeline: cheap fetch for all, rendering for the rest, one ordered result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import classify, html, text, urls
from textloom.schemas import RESULT

VERSION = "3.0"


def judge_fetched(fetched: DataFrame) -> DataFrame:
    """FETCHED rows plus title, text, text_length and reason (null: done without a browser)."""
    usable = F.col("fetch_error").isNull() & classify.is_html(F.col("content_type"))
    decoded = fetched.withColumn("_html", F.when(usable, F.coalesce(text.decode_body(F.col("body")), F.lit(""))))
    out = html.extract(decoded, "_html")
    reason = classify.fallback_reason(
        urls.is_special_site(F.col("url")), F.col("fetch_error"), F.col("content_type"),
        F.col("http_status"), F.col("_html"), F.col("text"),
    )
    return out.withColumn("reason", reason)


def _row(pos: Column, **values: Column) -> list[Column]:
    """RESULT's columns; pos keeps its type."""
    return [pos.alias("pos"), *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESULT.fields if f.name != "pos"]]


def fetch_results(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NULL").select(*_row(
        pos=F.col("pos"), requestedUrl=F.col("url"), success=classify.fetch_success(F.col("http_status")),
        method=F.lit("fetch"), status=F.col("http_status"), finalUrl=F.col("final_url"), title=F.col("title"),
        textLength=F.col("text_length"), blocked=F.lit(False), text=text.truncate_text(F.col("text")),
        durationMs=F.col("duration_ms"),
    ))


def render_results(rendered: DataFrame, reasons: DataFrame) -> DataFrame:
    """RENDERED rows joined with (pos, reason). A render error makes a failure row of its own."""
    clean = rendered.withColumns({"title": text.normalize_text(F.col("raw_title")), "text": text.normalize_text(F.col("raw_text"))})
    j = clean.join(reasons.select("pos", "reason"), "pos")
    bad = F.col("render_error").isNotNull()
    ok = lambda c: F.when(~bad, c)
    title, body = F.col("title"), F.col("text")
    return j.select(*_row(
        pos=F.col("pos"), requestedUrl=F.col("url"),
        success=F.coalesce(ok(classify.rendered_success(title, body)), F.lit(False)), method=F.lit("browser"),
        status=ok(F.coalesce(F.nullif(F.col("http_status"), F.lit(0)), F.lit(200))), finalUrl=ok(F.col("final_url")),
        title=ok(title), textLength=ok(text.utf16_length(body)), stillLoading=ok(classify.still_loading(body)),
        blocked=ok(classify.is_blocked(title, body)), text=ok(text.truncate_text(body)), fallbackReason=F.col("reason"),
        error=F.col("render_error"), durationMs=F.col("duration_ms"),
    ))


def refused(checked: DataFrame) -> DataFrame:
    """Failure rows of requests (pos, url, error) that never reach a connector."""
    return checked.select(*_row(pos=F.col("pos"), requestedUrl=F.col("url"), success=F.lit(False), error=F.col("error")))


def admit(requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """requests (pos, url) as RESULT rows of those refused, requests to fetch, and (pos, url, reason) of special sites."""
    parsed = requests.select("pos", "url", urls.parse_url(F.col("url")).alias("p"))
    bad = refused(parsed.filter("p.error IS NOT NULL").select("pos", "url", "p.error"))
    good = parsed.filter("p.error IS NULL").select("pos", F.col("p.canonical").alias("url"))
    special = urls.is_special_site(F.col("url"))
    skipped = good.filter(special).select("pos", "url", F.lit(classify.REASON_SPECIAL).alias("reason"))
    return bad, good.filter(~special), skipped


def scrape(
    requests: DataFrame, fetch: Callable[[DataFrame], DataFrame], render: Callable[[DataFrame], DataFrame], ordered: bool = False
) -> DataFrame:
    """requests (pos, url) to RESULT rows; pos has the input order, is unique and, with stored connectors, of any type.

    URLs are checked and made canonical first: what isn't http or https, can't be parsed or names a
    private host is a failure row and never fetched. ordered: sorted by pos, for requests capped
    at some URLs; a sort of all texts of a large table would only cost. Special sites never reach `fetch`, and only what needs a browser reaches `render`: stages
    and filters, as Catalyst can't know what a connector costs. The judged rows are persisted:
    both branches read them, and a filter on reason pushed below the text columns would repeat
    their long chains.
    """
    bad, wanted, skipped = admit(requests)
    judged = judge_fetched(fetch(wanted)).drop("body", "_html").persist()
    waiting = judged.filter("reason IS NOT NULL").select("pos", "url", "reason").unionByName(skipped)
    done = render_results(render(waiting.select("pos", "url")), waiting)
    out = fetch_results(judged).unionByName(done).unionByName(bad)
    return out.orderBy("pos") if ordered else out


def summarize(results: DataFrame, mode: str = "sync", with_results: bool = False) -> DataFrame:
    """One row of totals. with_results gathers the rows too: only for requests capped at a few URLs."""
    out = [
        F.count("*").alias("requested"),
        F.count_if("success").alias("successful"),
        (F.count("*") - F.count_if("success")).alias("failed"),
        F.count_if(F.col("method") == "fetch").alias("fetchCount"),
        F.count_if(F.col("method") == "browser").alias("browserCount"),
    ]
    if with_results:
        out.append(F.array_sort(F.collect_list(F.struct(*results.columns))).alias("results"))
    totals = results.agg(*out)
    return totals.select(F.lit(mode).alias("mode"), (F.col("successful") > 0).alias("success"), *totals.columns)
