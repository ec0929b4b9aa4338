r"""Sharding by rendezvous hashing: each record goes to the shard that bids lowest for its key.

A shard's bid is -ln(u) / weight, with u from a hash of shard and key, so shard i gets its share of the
weights, and one more shard can only win records: those it bids lowest for move into it, all others
stay. Bids need the key and the weights alone, so rows are assigned where they are read.

Places within a shard are numbered without a gap and without one task a shard: rows, as narrow as
the placing needs, are dealt in ranges of (shard, hash, order), counted by task and shard, and
numbered from where the tasks before end. The row's own number is part of the range, so copies of one
record, if they are a third of all rows, are split over tasks like any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh, read, small, text_or_empty

SHARDS = 8
SEED = 17
#: Hexadecimal digits of a hash that make u: 52 bits, exact in a double.
DIGITS = 13


def bid(key: Column, shard: int, weight: float, seed: int = SEED) -> Column:
    """struct<cost, shard, hash>; a null key bids as a key of its own."""
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("?"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), named)), 1, DIGITS), 16, 10).cast("bigint")
    u = (h + F.lit(0.5)) / F.lit(float(16**DIGITS))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"), h.alias("hash"))


def winner(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The lowest bid for key; shards of weight 0 don't bid."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be above 0")
    return F.array_min(F.array(*[bid(key, i, w, seed) for i, w in enumerate(weights) if w > 0]))


def assign(rows: DataFrame, key: str, weights: Sequence[float], seed: int = SEED, name: str = "shard") -> DataFrame:
    """rows with the shard of each, in a column of that name (replaced if it is there); a projection, no shuffle.

    Rows with equal keys are in one shard, those with a null key too.
    """
    return rows.withColumn(name, winner(F.col(key), weights, seed)["shard"])


def place(rows: DataFrame, shard: str, order: Sequence[str], name: str = "slot") -> DataFrame:
    """rows with the place of each in its shard, from 0 without a gap, in the order of the columns given, nulls first.

    Rows that tie in all of them are in any order. An empty table gives no rows.
    """
    own, at, run = (fresh(rows, x) for x in ("_own", "_at", "_run"))
    narrow = cut(rows).withColumn(own, F.monotonically_increasing_id())
    dealt = narrow.repartitionByRange(shard, *order, own).sortWithinPartitions(shard, *order)
    dealt = cut(dealt.drop(own).withColumns({at: F.monotonically_increasing_id()}).withColumn(run, F.shiftright(at, 33)))
    # a task's rows of one shard follow each other: their first number and their count are all that placing needs
    runs = dealt.groupBy(F.col(shard).alias("_s"), F.col(run).alias("_r")).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select("_s", "_r", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    shift = fresh(dealt, "_shift")
    runs = runs.select(F.struct("_s", "_r").alias(shift + "k"), F.col("_shift").alias(shift))
    j = dealt.join(small(runs), F.struct(F.col(shard).alias("_s"), F.col(run).alias("_r")) == F.col(shift + "k"))
    return j.withColumn(name, F.col(at) + F.col(shift)).select(*[c for c in rows.columns if c != name], name)


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown: float | None = 1.0, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of docs (doc_id, text and any more columns, which are left out).

    size: bytes of the text and one; text_crc32: of those bytes. A null text has none: 1 and 0. All rows without
    an id are in one shard, and rows that share an id too: the id decides. Within a shard, rows are in
    the order of their bid's hash, id (null first), checksum and size. grown: the weight of one more
    shard, in which case grown_shard says where a row would be then; None: null.
    """
    text = text_or_empty("text")
    won = winner(F.col("doc_id"), weights, seed)
    more = winner(F.col("doc_id"), [*weights, grown], seed)["shard"] if grown is not None else F.lit(None).cast("int")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), won.alias("won"), more.alias("grown_shard"),
    ).select("doc_id", "size", "text_crc32", "law", "won.shard", "won.hash", "grown_shard")
    placed = place(rows, "shard", ["hash", "doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * SHARDS, files: int = 1, seed: int = SEED) -> None:
    """docs as Parquet in a folder a shard. files: to how many files a shard's rows are dealt, by a hash of the whole row."""
    shard, part = fresh(docs, "shard"), fresh(docs, "_part")
    rows = assign(docs, key, weights, seed, shard).withColumn(part, F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    rows.repartition(len(weights) * files, shard, part).drop(part).write.mode("overwrite").partitionBy(shard).parquet(path)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(read(spark, sf_dir, "documents", "doc_id", "text"))


def _sql(n: int = SHARDS, seed: int = SEED) -> str:
    # CRC-32 by bytes, its table of 256 from the polynomial
    h = f"('0x' || substr(md5('{seed}:' || i || ':' || key), 1, {DIGITS}))::BIGINT"
    return rf"""
WITH RECURSIVE p(n, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM p WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM p WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1 ', 'g'), ' ') AS h, coalesce('=' || doc_id, '?') AS key FROM documents),
c AS (SELECT doc_id, size, key, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(h[:-2], lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) AS crc FROM d, tab),
b AS (SELECT *, list_transform(range({n + 1}), lambda i: {{'cost': -ln(({h} + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE), 'shard': i, 'hash': {h}}}) AS bids FROM c),
w AS (SELECT *, list_sort(bids[1:{n}])[1] AS won, list_sort(bids)[1] AS more FROM b)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, won.shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY won.shard ORDER BY won.hash, doc_id NULLS FIRST, crc, size) - 1 AS slot, more.shard::INTEGER AS grown_shard FROM w
"""


OP12_SQL = _sql()
