"""Hard negatives against every pair of rows, trees against distances, odd vectors."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=10, every=100):
    took = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        took.append((i, [math.floor(256 * float(np.float32(x))) for x in e], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = Counter()
    for a, v, label in {(i, tuple(v), x) for i, v, x in took if i is not None and i % every == 0}:
        scored = [(dot(v, w), i, x) for i, w, x in took if i != a]
        best = sorted((s for s in scored if s[2] == label), key=order)[:positives]
        for p, pid, _ in best:
            fits = sorted((s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            for rank, (s, i, _) in enumerate(fits, 1):
                out[a, pid, rank, i, p, s] += 1
    return out


def mined(spark, rows, **more):
    return Counter(tuple(r) for r in hn.mine(hn.vectors(spark.createDataFrame(rows, SCHEMA)), F.col("vec_id") % 100 == 0, **more).collect())


def made(r, n, dim, labels=4, centers=6):
    at = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(centers)]
    return [(i, [c + r.gauss(0, 0.4) for c in r.choice(at)], r.randrange(labels)) for i in range(n)]


def test_against_every_pair(spark, monkeypatch):
    r = random.Random(2)
    rows = made(r, 1500, 6)
    monkeypatch.setattr(hn, "BLOCK", 100)
    monkeypatch.setattr(hn, "BUCKET", 8)
    monkeypatch.setattr(hn, "VISITS", 5)
    want = plain(rows)
    assert len(want) > 300 and mined(spark, rows) == want
    monkeypatch.setattr(hn, "SAMPLE", 16)
    assert mined(spark, rows, positives=2, negatives=3) == plain(rows, 2, 3)


def test_odd_vectors(spark):
    r = random.Random(4)
    rows = made(r, 260, 5, 2, 2)
    inf, nan = math.inf, math.nan
    rows += [(2**60 + 4, rows[7][1], 0), (-100, rows[9][1], 1), (None, rows[3][1], 0), (None, rows[4][1], 1), (300, None, 0), (400, [1.0, None, 0.0, 0.0, 0.0], 0), (500, [inf, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(600, [nan] * 5, 1), (700, rows[1][1], None), (800, [], 0), (900, [0.0] * 5, 1), (1000, [0.3, 0.2], 0), (100, rows[100][1], rows[100][2]), (100, rows[100][1], rows[100][2]), (200, rows[5][1], 1), (1100, [1e-9, -1e-9, 0.0, 0.0, 0.0], 0)]
    rows += [(2000 + i, rows[0][1], i % 2) for i in range(60)]  # ties
    assert mined(spark, rows) == plain(rows)
    empty = spark.createDataFrame([], SCHEMA)
    for none in (empty, spark.createDataFrame(rows[260:262], SCHEMA).filter("vec_id = 5"), spark.createDataFrame([(100, [1.0], 1)], SCHEMA), spark.createDataFrame([(100, None, 1)], SCHEMA)):
        out = hn.mine(hn.vectors(none), F.col("vec_id") % 100 == 0)
        assert out.collect() == [] and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("v", "norm", "q", "region", "part", "group", "rank", "score")})
    assert Counter(tuple(x) for x in hn.mine(hn.vectors(clash), F.col("vec_id") % 100 == 0).collect()) == plain(rows)
    with pytest.raises(ValueError):
        hn.mine(hn.vectors(spark.createDataFrame([(100, [3e8], 1)], SCHEMA)), F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize(("alike", "share"), [(True, 0.5), (False, 0.7)])
def test_tree_bounds_and_pruning(monkeypatch, alike, share):
    """Rows of about one norm, as embeddings are, and rows of very different norms, whose distances say less about scores."""
    r = np.random.default_rng(1)
    rows = r.normal(0, 1, (4000, 3))
    rows[:2000] += 3000 / 256
    if alike:
        rows = r.normal(0, 1, (4000, 3))
        rows /= np.sqrt((rows * rows).sum(1))[:, None]
    rows = np.rint(rows * 256)
    norm = (rows * rows).sum(1).astype(np.int64)
    space = hn.Space(3, int(norm.max()))
    table = pa.table({"vec_id": np.arange(4000), "label": np.zeros(4000, np.int32), "v": pa.array(rows.astype(np.int64).tolist()), "norm": norm})
    points = space.points(table["v"], table["norm"])
    tree = hn.Tree(points, 64)
    leaf = tree.leaf_of(points)
    asked = space.anchors(table["v"].slice(0, 50))
    d = hn._far(asked, points)
    for exact in (False, True):
        if exact:
            tree.tighten(points, leaf)
        least, most = tree.bounds(asked, space.slack)
        assert all((least[i, leaf] <= d[i] + space.slack).all() and (d[i] <= most[i, leaf] + space.slack).all() for i in range(50))
    assert np.bincount(leaf, minlength=64).max() <= 400
    scored = []
    monkeypatch.setattr(hn.np, "rint", lambda x: scored.append(x.size) or np.round(x))
    at = np.arange(0, 4000, 100)
    queries = pa.table({"q": at, "a": at, "anchor_id": at, "label": np.ones(40, np.int32), "v": table["v"].take(pa.array(at)), "norm": norm[at], "low": np.full(40, hn.LEAST), "high": norm[at] // 2})
    got = hn.search_block(space, table, queries, 10, False).to_pandas()
    assert sum(scored) < share * 40 * 4000  # the other buckets are out of the annulus, or farther than the kth row
    for q in at:
        s = (rows @ rows[q]).astype(np.int64)
        fits = np.flatnonzero((s <= norm[q] // 2) & (np.arange(4000) != q))
        want = fits[np.lexsort((fits, -s[fits]))][:10]
        assert got[got.q == q].vec_id.tolist() == want.tolist()
