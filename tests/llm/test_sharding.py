"""Sharding against a plain reading of its rule: shares, movement, gapless places, odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import sharding


def plain(key, weights, seed=sharding.SEED):
    named = "?" if key is None else f"={key}"
    bids = []
    for i, w in enumerate(weights):
        if w:
            h = int(hashlib.md5(f"{seed}:{i}:{named}".encode()).hexdigest()[:13], 16)
            bids.append((-math.log((h + 0.5) / 16**13) / w, i, h))
    return min(bids)


def check(rows, given, n=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    assert all(r.shard == plain(r.doc_id, [1] * n)[1] and r.grown_shard == plain(r.doc_id, [1] * (n + 1))[1] and r.law == "key" for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        least = lambda r: (plain(r.doc_id, [1] * n)[2], r.doc_id is not None, r.doc_id or 0, r.text_crc32, r.size)
        assert [least(r) for r in sorted(own, key=lambda r: r.slot)] == sorted(map(least, own))


def test_shards_of_odd_rows(spark, odd, odd_rows, empty):
    out = sharding.shards(odd)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(out.collect(), [(r[0], r[1]) for r in [*odd_rows, odd_rows[0]]])
    assert sharding.shards(empty).count() == 0 and sharding.shards(empty).columns == out.columns
    ids = [(i, t) for i in (2**60 + 1, -5, None, 2**63 - 1, -(2**63)) for t in ("a", None, "a", "é\U0001F600")]
    check(sharding.shards(spark.createDataFrame(ids, "doc_id long, text string")).collect(), ids)
    clash = odd.withColumns({c: F.lit(c) for c in ("shard", "slot", "won", "hash", "_own", "_at", "_run", "_shift", "law", "size")})
    assert Counter(sharding.shards(clash).collect()) == Counter(out.collect())


def test_hot_copies_are_placed_by_many_tasks(spark):
    """A third of all rows are one record: it has places without a gap, and no task has it alone."""
    n = 9000
    docs = spark.range(n, numPartitions=9).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = sharding.shards(docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(rows, [(7 if i % 3 == 0 else i, "x") for i in range(n)])
    hot = Counter(r.task for r in rows if r.doc_id == 7)
    assert len(hot) >= 2 and max(Counter(r.task for r in rows).values()) < n / 2
    assert Counter(rows_again[:7] for rows_again in sharding.shards(docs.repartition(4)).collect()) == Counter(r[:7] for r in rows)


def test_weights_and_movement(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"))
    w = [1.0, 3.0, 0.0, 4.0]
    got = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", w).collect()}
    share = Counter(got.values())
    assert share[2] == 0 and all(abs(share[i] / 20_000 - w[i] / 8) < 0.015 for i in (0, 1, 3))
    more = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [*w, 2.0]).collect()}
    moved = [i for i in got if got[i] != more[i]]
    assert {more[i] for i in moved} == {4} and abs(len(moved) / 20_000 - 0.2) < 0.015
    less = {r.doc_id: r.shard for r in sharding.assign(docs, "doc_id", [1.0, 3.0, 0.0, 2.0]).collect()}  # a lower weight only gives rows away
    assert {got[i] for i in got if got[i] != less[i]} == {3}
    for bad in ([], [0.0], [1.0, -1.0]):
        with pytest.raises(ValueError):
            sharding.assign(docs, "doc_id", bad)


def test_written_shards(spark, tmp_path):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    sharding.write_shards(docs, str(tmp_path / "out"), weights=(1.0, 1.0, 2.0), files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in sharding.assign(docs, "doc_id", (1.0, 1.0, 2.0)).collect()}


def test_main_path_is_native(spark, data, capsys):
    sharding.op12_sharding(spark, data).explain("formatted")
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))
