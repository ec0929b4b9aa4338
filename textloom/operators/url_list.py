"""Lists of URLs: keep strings, trim, canonicalise, first of each in order, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import urls
from textloom.functions.text import WS_CLASS


def parse_request(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON body to urls: array<string> with entries that aren't strings dropped; null if urls is no list.

    A body that isn't JSON gives request_error, which normalize_lists reports before any other error.
    """
    parsed = F.try_parse_json(F.col(body))
    entries = F.try_variant_get(parsed, "$.urls", "array<variant>")
    strings = F.filter(entries, lambda v: F.schema_of_variant(v) == "STRING")
    return df.withColumns({
        "request_error": F.when(parsed.isNull(), F.lit(urls.NOT_JSON)),
        "urls": F.transform(strings, lambda v: F.try_variant_get(v, "$", "string")),
    })


def trimmed(c):
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def normalize_lists(df: DataFrame, maximum: int, key: str = "request_id", urls_col: str = "urls") -> DataFrame:
    """One row per request: key, urls (distinct canonical, first-seen order), error.

    The first entry that can't be canonicalised fails the whole list; the cap applies to
    what is left after removing repeats. Requests are short lists by contract, so a list
    is put together again by one aggregation on the request key.
    """
    broken = F.col("request_error") if "request_error" in df.columns else F.lit(None).cast("string")
    entries = df.select(key, broken.alias("_broken"), F.col(urls_col).isNull().alias("_no"), F.posexplode_outer(urls_col).alias("pos", "raw"))
    entries = entries.withColumn("raw", trimmed(F.col("raw"))).withColumn("raw", F.when(F.col("raw") != "", F.col("raw")))
    parsed = entries.withColumn("p", urls.parse_url(F.col("raw")))
    used = F.col("raw").isNotNull()
    lists = parsed.groupBy(key).agg(
        F.max("_no").alias("_no"),
        F.max("_broken").alias("_broken"),
        F.min(F.when(used & F.col("p.error").isNotNull(), F.struct("pos", F.col("p.error").alias("error")))).alias("_bad"),
        F.array_sort(F.collect_list(F.when(used & F.col("p.error").isNull(), F.struct("pos", F.col("p.canonical").alias("u"))))).alias("_ok"),
    )
    distinct = F.array_distinct(F.transform("_ok", lambda x: x["u"]))
    error = (
        F.when(F.col("_broken").isNotNull(), F.col("_broken"))
        .when(F.col("_no"), urls.NOT_A_LIST)
        .when(F.col("_bad").isNotNull(), F.col("_bad.error"))
        .when(F.size(distinct) == 0, urls.NO_URL)
        .when(F.size(distinct) > maximum, urls.TOO_MANY.format(maximum))
    )
    return lists.select(key, F.when(error.isNull(), distinct).alias("urls"), error.alias("error"))


def distinct_urls(df: DataFrame, canonical: str = "canonical", order: str = "pos") -> DataFrame:
    """The relational form: of rows with one canonical URL the first by `order` stays.

    min_by combines map-side, so a URL that a third of all rows share doesn't land in one task.
    """
    rest = [c for c in df.columns if c != canonical]
    first = df.groupBy(canonical).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("_r"))
    return first.select(canonical, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)
