"""Requests to endpoints, and rows to JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.urls import decode_component

#: Method and pattern of a path to the endpoint, the first that matches; a group is the job's id.
ROUTES = [
    ("POST", "^/scrape-many$", "scrape_many"),
    ("POST", "^/jobs$", "create_job"),
    ("GET", "^/jobs/([^/]+)/results$", "job_results"),
    ("GET", "^/jobs/([^/]+)$", "job"),
    ("POST", "^/batch$", "batch"),
    ("GET", "^/(?:scrape)?$", "single"),
]
PREFLIGHT = "preflight"

#: Headers of every JSON body.
JSON_HEADERS = {
    "Content-Type": "application/json; charset=utf-8",
    "Access-Control-Allow-Origin": "*",
    "Access-Control-Allow-Methods": "GET, POST, OPTIONS",
    "Access-Control-Allow-Headers": "Content-Type",
    "Cache-Control": "no-store, no-cache, must-revalidate",
    "Pragma": "no-cache",
    "Expires": "0",
}


def match_route(method: Column, path: Column) -> Column:
    """struct<endpoint, job_id>: endpoint null if there's none; job_id percent-decoded, null where a route has none."""
    endpoint, job = F.when(method == "OPTIONS", PREFLIGHT), F.lit(None).cast("string")
    for verb, pattern, name in ROUTES:
        fits = (method == verb) & path.rlike(pattern)
        endpoint = endpoint.when(fits, name)
        if "(" in pattern.replace("(?:", ""):
            job = F.when(fits, decode_component(F.regexp_extract(path, pattern, 1))).otherwise(job)
    return F.struct(endpoint.alias("endpoint"), job.alias("job_id"))


def to_json(df: DataFrame) -> DataFrame:
    """body: each row as a JSON object, with its nulls."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("body"))
