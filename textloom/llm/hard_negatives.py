r"""Hard-negative mining: rows of other labels that score somewhat below an anchor's positives.

A row x is augmented to (x, sqrt(M - |x|**2)) and an anchor a to (a, 0), M being the largest squared norm. Their
squared distance is then |a|**2 + M - 2 * score, so the highest scores are the nearest rows, and a window of
scores is an annulus around the anchor.

Rows are dealt to the regions of a vantage-point tree fitted on a bounded sample, and within a region to blocks
of at most about BLOCK rows by a hash, copies of one row too. Each block gets a vantage-point tree of its own. A
query visits the region that is nearest to it inside its annulus first, and then, in two rounds, those
regions that can still hold something nearer than the kth row found; within a block its buckets likewise,
nearest first, until the next is farther than the kth row or outside the annulus. Bounds only leave out what
can't count; scores are exact integers. (Where rows point in all directions of many dimensions,
distances are alike and bounds leave out little: then the work is that of anchors times rows, in blocks.)

Queries of a block are dealt in groups of about VISITS, each with a copy of the block, so neither a block
that all queries visit nor a group grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, read, small

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is within these hundredths of its positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows of the sample that the regions' tree is fitted on, and how many regions there are at most.
SAMPLE, REGIONS = 4096, 64
#: Which of a query's regions, nearest first, it visits in each round.
ROUNDS = [(0, 1), (1, 9), (9, REGIONS)]
#: Rows of a block and of a bucket of its tree; queries of a group.
BLOCK, BUCKET, VISITS = 1024, 32, 2048
#: Squared norms up to this are exact in a double, and so are all scores.
EXACT = 2**53
LEAST, MOST = -(2**62), 2**62

_ROW = "vec_id bigint, label int, v array<bigint>, norm bigint"
_QUERY = "q bigint, a bigint, anchor_id bigint, label int, v array<bigint>, norm bigint, low bigint, high bigint"
_FOUND = "q bigint, vec_id bigint, score bigint"


def vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (components in whole steps of 1 / scale, rounded down) and norm (squared) of the rows that take part.

    Left out: a null label or vector, a null, infinite or NaN component. Vectors of different lengths meet as if the shorter
    one ended in zeros.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = rows.filter(F.col("label").isNotNull() & x.isNotNull()).filter(finite)
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    out = kept.select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), v.alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return out.withColumn("norm", F.least(norm, F.lit(2.0 * EXACT)).cast("bigint"))  # whole up to EXACT, and above it no more than that


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """The vectors of a column as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of a from rows of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


class Tree:
    """A vantage-point tree: inner node n has children 2n+1 (inside the radius of vantage[n], or on it) and 2n+2.

    What is in a node is in a shell around its parent's vantage point, from inner[n] to outer[n].
    """

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        self.leaves = leaves
        self.vantage = np.zeros((leaves - 1, points.shape[1]))
        self.radius = np.zeros(leaves - 1)
        self.inner, self.outer = np.zeros(2 * leaves - 1), np.full(2 * leaves - 1, np.inf)
        at = {0: np.arange(len(points))}
        for n in range(leaves - 1):
            own = at.pop(n)
            inside = outside = own[:0]
            if len(own):
                start = _far(points[own[:1]], points[own])[0]
                self.vantage[n] = points[own[np.argmax(start)]]  # from the edge, distances spread most
                d = _far(self.vantage[n : n + 1], points[own])[0]
                self.radius[n] = np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2]
                inside, outside = own[d <= self.radius[n]], own[d > self.radius[n]]
            at[2 * n + 1], at[2 * n + 2] = inside, outside
            self.outer[2 * n + 1] = self.inner[2 * n + 2] = self.radius[n]

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        n = np.zeros(len(points), np.int64)
        d = _far(points, self.vantage)
        for _ in range(self.leaves.bit_length() - 1):
            n = 2 * n + 1 + (d[np.arange(len(n)), n] > self.radius[n])
        return n - (self.leaves - 1)

    def tighten(self, points: np.ndarray, leaf: np.ndarray) -> None:
        """Shells by the points that are there, all of them, instead of the radii."""
        d = _far(points, self.vantage)
        self.inner[:], self.outer[:] = np.inf, -np.inf
        node = leaf + self.leaves - 1
        for _ in range(self.leaves.bit_length() - 1):
            up = (node - 1) // 2
            own = d[np.arange(len(node)), up]
            np.minimum.at(self.inner, node, own)
            np.maximum.at(self.outer, node, own)
            node = up

    def bounds(self, points: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) possible distance of each point from what is in each leaf."""
        d = _far(points, self.vantage)
        least = np.zeros((len(points), 2 * self.leaves - 1))
        most = np.full_like(least, np.inf)
        for n in range(1, 2 * self.leaves - 1):
            up = (n - 1) // 2
            least[:, n] = np.maximum(least[:, up], np.maximum(d[:, up] - self.outer[n], self.inner[n] - d[:, up]) - slack)
            most[:, n] = np.minimum(most[:, up], d[:, up] + self.outer[n] + slack)
        return least[:, self.leaves - 1 :], most[:, self.leaves - 1 :]


def _power(n: float, most: int) -> int:
    """The least power of two that is n or more, from 1 to most."""
    p = 1
    while p < n and p < most:
        p *= 2
    return p


class Space:
    """What maps scores to distances, and the regions of the space."""

    def __init__(self, width: int, top: int, sample: DataFrame | None = None, rows: int = 0) -> None:
        self.width, self.top = width, top
        self.slack = 1e-6 * (1 + top**0.5)
        self.regions: Tree | None = None
        if sample is not None:
            table = sample.select("v", "norm").toArrow()
            leaves = _power(rows / BLOCK, REGIONS)
            self.regions = Tree(self.points(table["v"], table["norm"]), leaves)

    def points(self, v, norm) -> np.ndarray:
        last = np.sqrt(np.maximum(0, self.top - norm.to_numpy().astype(np.float64)))
        return np.hstack([_matrix(v, self.width), last[:, None]])

    def anchors(self, v) -> np.ndarray:
        m = _matrix(v, self.width)
        return np.hstack([m, np.zeros((len(m), 1))])

    def distance(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norm.astype(np.float64) + self.top - 2.0 * score.astype(np.float64)))

    def annulus(self, norm: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest distance of what scores from low to high."""
        return self.distance(high, norm) - self.slack, self.distance(low, norm) + self.slack


def _space(rows: DataFrame) -> tuple[Space, int]:
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("norm"), F.lit(0)).alias("top"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    if size.top > EXACT:
        raise ValueError("scores of these vectors aren't exact in 53 bits")
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE)
    return Space(size.width, size.top, sample, size.n), size.n


def _regions_of(rows: DataFrame, space: Space) -> DataFrame:
    """rows with their region and block: (region, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = space.regions.leaf_of(space.points(b["v"], b["norm"]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "region"])

    dealt = cut(rows.mapInArrow(run, _ROW + ", region int").withColumn("_n", F.monotonically_increasing_id()))
    parts = dealt.groupBy("region").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # the row's number is in the hash, so that copies of one row are dealt too
    return cut(dealt.join(small(cut(parts)), "region").withColumn("part", F.pmod(F.xxhash64("vec_id", "_n"), F.col("parts")).cast("int")).drop("_n", "parts"))


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(space: Space, rows: pa.Table, queries: pa.Table, k: int, same: bool) -> pa.Table:
    """The first k rows of the block for each query: of its label (same), or of others, its own row apart, and in its window.

    Each query takes the buckets of the block's tree nearest first, all queries in step, and leaves when the next one is
    farther than its kth row. The windows of one anchor share its products with a bucket.
    """
    points = space.points(rows["v"], rows["norm"])
    tree = Tree(points, _power(len(rows) / BUCKET, 1 << 20))
    leaf = tree.leaf_of(points)
    tree.tighten(points, leaf)
    order = np.argsort(leaf, kind="stable")
    edge = np.searchsorted(leaf[order], np.arange(tree.leaves + 1))
    ids, known, label = rows["vec_id"].fill_null(0).to_numpy()[order], rows["vec_id"].is_valid().to_numpy()[order], rows["label"].to_numpy()[order]
    data = np.ascontiguousarray(points[order, :-1])
    q, norm, low, high, q_label, q_id = (queries[c].to_numpy() for c in ("q", "norm", "low", "high", "label", "anchor_id"))
    low = low.copy()  # rises to the kth score
    _, first, anchor = np.unique(queries["a"].to_numpy(), return_index=True, return_inverse=True)
    asked = space.anchors(queries["v"].take(pa.array(first)))
    near, far = space.annulus(norm, low, high)
    least, most = tree.bounds(asked, space.slack)
    least, most = np.maximum(least[anchor], near[:, None]), most[anchor]
    least[(most < near[:, None]) | (least > far[:, None])] = np.inf
    path = np.argsort(least, axis=1, kind="stable")
    asked = np.ascontiguousarray(asked[:, :-1])
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)  # scores and rows of each query, best first
    active, step = np.arange(len(q)), 0
    while len(active) and step < tree.leaves:
        bucket = path[active, step]
        going = least[active, bucket] <= far[active]
        active, bucket = active[going], bucket[going]
        for n in np.unique(bucket):
            own = active[bucket == n]
            at = slice(edge[n], edge[n + 1])
            who, back = np.unique(anchor[own], return_inverse=True)
            score = np.rint(asked[who] @ data[at].T).astype(np.int64)[back]
            fits = (score >= low[own][:, None]) & (score <= high[own][:, None])
            fits &= ((label[at][None] == q_label[own][:, None]) == same) & ~(known[at][None] & (ids[at][None] == q_id[own][:, None]))
            for i in np.flatnonzero(fits.any(1)):
                w = own[i]
                s, r = np.concatenate([best[w][0], score[i, fits[i]]]), np.concatenate([best[w][1], edge[n] + np.flatnonzero(fits[i])])
                top = np.lexsort((ids[r], ~known[r], -s))[:k]
                best[w] = (s[top], r[top])
                if len(top) == k:
                    low[w] = s[top[-1]]
                    far[w] = space.distance(low[w : w + 1], norm[w : w + 1])[0] + space.slack
        step += 1
    score, row = np.concatenate([b[0] for b in best]), np.concatenate([b[1] for b in best])
    return pa.table({"q": pa.array(np.repeat(q, [len(b[0]) for b in best]), pa.int64()), "vec_id": pa.array(ids[row], pa.int64(), mask=~known[row]), "score": pa.array(score, pa.int64())})


def _visit(blocks: DataFrame, visits: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """What visits (a query and a region) find in the blocks of their regions."""
    sizes = cut(blocks.select("region", "part").distinct())
    parts = sizes.join(small(cut(visits.groupBy("region").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("groups")))), "region")
    parts = small(cut(parts))
    copies = blocks.join(parts, ["region", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asked = visits.join(parts, "region").withColumn("group", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns if c != "groups"])  # columns of its own beside those of copies
    key = ["region", "part", "group"]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return pa.table({"q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return search_block(space, rows, queries, k, same)

    return copies.drop("groups").groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, _FOUND)


def nearest(blocks: DataFrame, queries: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """q, vec_id, score and rank of the k best rows for each query (_QUERY columns): in its window, of its label or of others, without its own id.

    Regions are visited in rounds, nearest first; each round's kth score bounds the regions and the scores of the next.
    """

    def regions(batches: Iterator[pa.RecordBatch], start: int, end: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            norm, low = b["norm"].to_numpy(), b["low"].to_numpy()
            near, far = space.annulus(norm, low, b["high"].to_numpy())
            kth = b["kth"].fill_null(LEAST).to_numpy()
            least, most = space.regions.bounds(space.anchors(b["v"]), space.slack)
            least = np.maximum(least, near[:, None])
            least[(most < near[:, None]) | (least > far[:, None])] = np.inf
            place = np.argsort(np.argsort(least, axis=1, kind="stable"), axis=1, kind="stable")
            limit = np.minimum(far, space.distance(kth, norm) + space.slack)
            q, region = np.nonzero((place >= start) & (place < end) & (least <= limit[:, None]))
            out = b.select(names).take(pa.array(q))
            out = out.set_column(names.index("low"), "low", pa.array(np.maximum(low, kth)[q]))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(region.astype(np.int32))], names=[*names, "region"])

    names = [x.split()[0] for x in _QUERY.split(", ")]
    found, kth = None, queries.select("q", F.lit(None).cast("bigint").alias("kth")).limit(0)
    for start, end in ROUNDS:
        asked = queries.select(*names).join(kth, "q", "left").select(*names, "kth")
        visits = cut(asked.mapInArrow(lambda batches, s=start, e=end: regions(batches, s, e), _QUERY + ", region int"))
        more = _visit(blocks, visits, space, k, same)
        found = cut(_best(more if found is None else found.drop("rank").unionByName(more), k))
        kth = found.filter(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    return found


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    rows: as vectors() gives them. anchors: which of them are anchors. An anchor's positives are the best other rows of its
    label; for each, the best rows of other labels whose score is from low to high hundredths of the positive's, ties by the
    smaller id, a null id last. Other rows are those with another id, or without one. Rows that repeat id, label and vector are
    one anchor, but each of them counts as a positive or negative. Without a row of either kind, or
    in an empty table, there are no rows. Scores that a double can't hold exactly raise an error.
    """
    rows = cut(rows)
    space, n = _space(rows)
    if not n:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    blocks = _regions_of(rows, space)
    asked = cut(rows.filter(anchors).distinct().withColumn("q", F.monotonically_increasing_id()))
    queries = asked.select("q", F.col("q").alias("a"), F.col("vec_id").alias("anchor_id"), "label", "v", "norm", F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    best = nearest(blocks, queries, space, positives, True)
    pairs = best.select(F.col("q").alias("a"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("nth"))
    # the window in whole scores; empty if the positive's score is negative
    p = F.col("positive_score")
    window = {"low": F.ceil(low * p / F.lit(100).cast("decimal(20,0)")).cast("bigint"), "high": F.floor(high * p / F.lit(100).cast("decimal(20,0)")).cast("bigint")}
    pairs = cut(pairs.withColumns(window).withColumn("q", F.monotonically_increasing_id()))
    windows = pairs.filter("low <= high").join(small(asked.select(F.col("q").alias("a"), F.col("vec_id").alias("anchor_id"), "label", "v", "norm")), "a")
    found = nearest(blocks, cut(windows.select("q", "a", "anchor_id", "label", "v", "norm", "low", "high")), space, negatives, False)
    named = pairs.join(small(asked.select(F.col("q").alias("a"), F.col("vec_id").alias("anchor_id"))), "a")
    out = found.select("q", F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(small(named), "q")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors(e.withColumn("label", moved)), F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS r
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) <= {NEGATIVES}
"""
