"""A URL that is stored several times: each request has one row, and that is its own page's."""

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.plans import queries
from textloom.sources.pages import stored_pages, stored_renders


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """48 pages under 40 URLs."""
    d = tmp_path_factory.mktemp("repeated")
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").filter("page_id < 40").select("page_id", "url", "html")
    again = p.filter("page_id < 8").join(p.select((F.col("page_id") - 8).alias("page_id"), F.col("html").alias("other")), "page_id")
    p.unionByName(again.select((F.col("page_id") + 41).alias("page_id"), "url", F.col("other").alias("html"))).write.parquet(f"{d}/pages.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["scrape_results", "scrape_summary"])
def test_scrape_of_repeated_urls(spark, repeated, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{repeated}/pages.parquet/*.parquet')")
    want = c.execute(queries.SQL[name]).fetchall()
    got = [tuple(r) for r in queries.Q[name](spark, repeated).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stored_under_urls_alone_gives_one_row_a_request(spark):
    pages = spark.createDataFrame([("u", "b"), ("u", "a"), ("v", "c")], "url string, html string")
    asked = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v"), (4, "w")], "pos int, url string")
    got = {r.pos: r for r in stored_pages(pages)(asked).collect()}
    assert stored_pages(pages)(asked).count() == 4
    assert [bytes(got[i].body) for i in (1, 2, 3)] == [b"b", b"b", b"c"] and got[4].fetch_error == "not stored"
    renders = pages.select("url", F.lit("t").alias("raw_title"), F.col("html").alias("raw_text"))
    assert sorted((r.pos, r.raw_text) for r in stored_renders(renders)(asked).collect()) == [(1, "b"), (2, "b"), (3, "c"), (4, None)]


@pytest.mark.parametrize("name", ["scrape_results", "scrape_summary"])
def test_scrape_of_repeated_ids(spark, tmp_path, name):
    """A table repeated without shifted ids, once with the same bodies and once with others: a row for each page."""
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    other = p.select("page_id", F.concat("url", F.lit("?again")).alias("url"), F.substring("html", 1, 300).alias("html"))
    p.unionByName(p).unionByName(other).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(queries.SQL[name]).fetchall()
    got = [tuple(r) for r in queries.Q[name](spark, str(tmp_path)).collect()]
    assert len(want) == (1 if name == "scrape_summary" else 150) and sorted(got, key=str) == sorted(want, key=str)


def test_pages_without_an_id_or_a_body_have_a_row_each(spark, tmp_path):
    p = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").filter("page_id < 10")
    missing = lambda c, k: F.when(F.col("page_id") % 3 != k, F.col(c)).alias(c)
    p.select(missing("page_id", 0), "url", missing("html", 1)).write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.Q["scrape_results"](spark, str(tmp_path)).collect()
    assert sorted(r.requestedUrl for r in got) == sorted(r.url for r in p.collect())
    assert queries.Q["scrape_summary"](spark, str(tmp_path)).first().requested == 10
