"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Every row is probed where it is read, before any shuffle. Only what passes the filter goes on to
the join, which removes the false positives, so the verdict is exact whatever the filter's size.
The filter is a table of blocks of 4 x 64 bits built by aggregation (bit_or combines map-side);
a URL's hash picks the block and one bit in each word. It has as many blocks as the list needs, MAX_BLOCKS at most: up to there it is
broadcast, being MAX_BLOCKS * 40 bytes at most. A longer list only makes it denser; past
DENSE URLs a block the filter would pass everything and is left out, and all URLs go to
the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SMALL_ROWS, cut, fresh

WORDS = 4
URLS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 16
DENSE = 256

#: (rule, verdict); a rule is host, slash, path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Hosts whose pages make the list of the registered query.
LISTED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com"]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """host (without leading www. or m. and default port), path without trailing slash or index
    page, query without tracking parameters; scheme and fragment go. Null or without ://: null."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(?:www|m)\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"(?:/index\.html?)?/*$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, r"(?:^|&)(?:utm_[^=&]*|gclid|fbclid|ref)=?[^&]*", ""), "^&", "")
    return F.when(url.contains("://"), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def apply_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none: a chain from long to short.

    Rules are a hand-written list, of some hundreds at most.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def slots(canon: Column, n_blocks: int) -> Column:
    """struct<block, other>: the block of a canonical URL and the hash whose bits pick one bit in each of its words."""
    return F.struct(F.pmod(F.xxhash64(canon), F.lit(n_blocks)).cast("int").alias("block"), F.xxhash64(F.lit(7), canon).alias("other"))


def _bit(other: Column, i: int) -> Column:
    place = F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63).cast("bigint")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """listed (canon: distinct canonical URLs) to block, w0 to w3."""
    rows = listed.select(slots(F.col("canon"), n_blocks).alias("s")).select("s.block", *[_bit(F.col("s.other"), i).alias(f"w{i}") for i in range(WORDS)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def probed(rows: DataFrame, canon: str, blocks: DataFrame, n_blocks: int) -> tuple[DataFrame, Column]:
    """rows with two columns more, and whether the filter passes a row's canonical URL (null: no).

    A map-side join on one row a block, which keeps all rows where they are.
    """
    at = fresh(rows, "_slots")
    bits = fresh(rows, "_block")
    table = F.broadcast(blocks.select(F.struct(*blocks.columns).alias(bits)))  # MAX_BLOCKS rows of five numbers at most
    j = rows.withColumn(at, F.when(F.col(canon).isNotNull(), slots(F.col(canon), n_blocks)))
    j = j.join(table, F.col(at)["block"] == F.col(bits)["block"], "left")
    passed = F.col(bits).isNotNull()
    for i in range(WORDS):
        passed = passed & (F.col(bits)[f"w{i}"].bitwiseAND(_bit(F.col(at)["other"], i)) != 0)
    return j, F.coalesce(passed, F.lit(False))


def candidates(rows: DataFrame, canon: str, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, Column]:
    """rows with columns more, and the condition for those that may be in listed (canon, distinct): no false negatives."""
    n = listed.count()
    n_blocks = 1
    while n_blocks < max_blocks and n_blocks * URLS_PER_BLOCK < n:
        n_blocks *= 2
    if n > n_blocks * DENSE:
        return rows, F.col(canon).isNotNull()
    return probed(rows, canon, bloom_blocks(listed, n_blocks), n_blocks)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", max_blocks: int = MAX_BLOCKS, small_rows: int = SMALL_ROWS) -> DataFrame:
    """pages with host, path, rule and verdict (and nothing of the same names from before).

    listed: canon, canonical URLs to block. A null url, or one without ://, has empty host and
    path, fits no rule and is allowed; repeated rows are judged alike; an empty list blocks none;
    an empty table gives no rows; columns of pages keep their names and values.
    What passes the filter is made distinct, map-side first, so a URL that a third of the rows
    share is looked up once. Confirmed URLs go back to the rows by broadcast if they are
    small_rows at most; else only the rows that passed are shuffled to them.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    canon, says = fresh(base, "_canon"), fresh(base, "_says")
    rows = base.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), canon: canonical(F.col(url))})
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, says: verdict})
    rows = rows.withColumn(canon, F.when(F.col(says).isNull(), F.col(canon)))  # what a rule decides isn't looked up
    known = cut(listed.select("canon").filter("canon IS NOT NULL").distinct())
    marked, passed = candidates(rows, canon, known, max_blocks)
    # the aggregation keeps the optimizer from joining before it has probed
    hit = fresh(marked, "_hit")
    hits = cut(marked.filter(passed).select(F.col(canon).alias("canon")).distinct().join(known, "canon")).select(F.col("canon").alias(hit))
    if hits.limit(small_rows + 1).count() <= small_rows:
        j = rows.join(F.broadcast(hits), F.col(canon) == F.col(hit), "left")
    else:
        j = marked.filter(passed).join(hits, F.col(canon) == F.col(hit), "left")
        j = j.unionByName(marked.filter(~passed).withColumn(hit, F.lit(None).cast("string")))
    blocked = F.when(F.col(hit).isNotNull(), "block").otherwise("allow")
    return j.withColumn("verdict", F.coalesce(F.col(says), blocked)).select(*base.columns, "host", "path", "rule", "verdict")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page against the rules and the list of canonical URLs seen on LISTED_HOSTS."""
    from textloom.llm.common import read

    pages = read(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.filter(host_of(F.col("url")).rlike(r"^(?:[^/]*\.)?(?:" + "|".join(h.replace(".", r"\.") for h in LISTED_HOSTS) + ")$"))
    return judge(pages, listed.select(canonical(F.col("url")).alias("canon"))).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
p AS (SELECT page_id, u, translate(regexp_extract(u, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(u, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, CASE WHEN contains(u, '://') THEN regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), ':(?:80|443)$', '') || regexp_replace(path, '(?:/index\.html?)?/*$', '')
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS canon
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_extract(u, '^[^?#]*\?([^#]*)', 1), '(?:^|&)(?:utm_[^=&]*|gclid|fbclid|ref)=?[^&]*', '', 'g'), '^&', '') AS q FROM p)),
l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(host, '^(?:[^/]*\.)?(?:spam-farm\.example\.org|cheap-pills\.example\.com)$')),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM c)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
