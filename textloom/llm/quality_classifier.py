"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel, so that a linear fit is a kernel fit. Its normal
equations are sums over rows: each partition adds up its own and Spark sums those, entry by
entry, so the driver gets (FEATURES + 1) ** 2 numbers whatever the number of rows. Scores of
a fifth of the learning rows, which the fit hasn't seen, are counted in BINS bins and made
monotone by pooling adjacent violators.

Texts are read once, for the statistics; all that follows works on those narrow rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut
from textloom.llm.vectext import exact, map_batches, windows, word_hashes

FEATURES = 160
WIDTH = 4.0  # of the kernel, in standard deviations
RIDGE = 1e-3
SEED = 5
BINS = 1000
THRESHOLD = 0.7
#: Bound of the learning sample: labelled rows beyond it are thinned by a hash of doc_id.
MAX_LABELLED = 500_000
PARTS = 16

SYMBOLS = re.compile(r"[#*$%&<>|^~=@\\{}\[\]_]")
NAMES = ["words", "chars", "word_length", "symbols", "bars", "bangs", "capitals", "digits", "marks", "repeats",
         "copies", "variety", "line_length", "ended", "letters", "other"]
_SENTENCE_ENDS = tuple(".!?:;\"')…")
_BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def statistics(text: str | None, words: np.ndarray) -> list[float]:
    """NAMES of one text, all finite; an empty one has zeros."""
    t = text or ""
    n, c = len(words), len(t)
    if not n:
        return [0.0, math.log1p(c)] + [0.0] * (len(NAMES) - 2)
    lines = [x for x in t.split("\n") if x.strip()]
    threes = windows(words, 3)
    upper = sum(map(str.isupper, t))
    letters = sum(map(str.isalpha, t))
    digits = sum(map(str.isdigit, t))
    blanks = sum(len(x) for x in _BLANKS.findall(t))
    bangs = t.count("!")
    return [
        math.log1p(n), math.log1p(c), min(30.0, (c - blanks) / n), min(5.0, len(SYMBOLS.findall(t)) / n), min(2.0, t.count("|") / n), min(3.0, bangs / n),
        upper / max(1, letters), digits / c, (t.count(".") + t.count(",")) / n, 1 - len(np.unique(threes)) / len(threes),
        1 - len(set(lines)) / max(1, len(lines)), len(np.unique(words)) / n, math.log1p(c / max(1, len(lines))),
        sum(x.rstrip().endswith(_SENTENCE_ENDS) for x in lines) / max(1, len(lines)), letters / c, (c - letters - digits - blanks) / c,
    ]


def _stats_of(frame: pd.DataFrame) -> pd.DataFrame:
    texts = list(frame["text"])
    return pd.DataFrame({"doc_id": frame["doc_id"], "x": [statistics(t, w) for t, w in zip(texts, word_hashes(texts), strict=True)]})


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["sd"], -6, 6)
    return np.hstack([np.cos(z @ model["w"] + model["b"]) * math.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _sums(rows: DataFrame, model: dict) -> DataFrame:
    """(i, j, v): the entries of the normal equations' upper triangle with y as the last column, per partition."""
    d = FEATURES + 2
    upper = np.triu_indices(d)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for f in frames:
            if len(f):
                a = np.hstack([fourier(np.array(f["x"].tolist()), model), f[["y"]].to_numpy(float)])
                total += a.T @ a
        if total[-2, -2]:
            yield pd.DataFrame({"i": upper[0], "j": upper[1], "v": total[upper]})

    return rows.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def pool_adjacent(counts: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """(score, positives, rows) in order of score to the points of a non-decreasing function."""
    blocks: list[list[float]] = []
    for s, y, n in counts:
        blocks.append([s * n, y, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [b[0] / b[2] for b in blocks], [b[1] / b[2] for b in blocks]


def fit(stats: DataFrame, labelled: DataFrame, max_rows: int = MAX_LABELLED) -> dict | None:
    """stats (doc_id, x), labelled (doc_id, y). None without both labels.

    Statistics are standardised over all rows, labelled or not.
    """
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000))
    n = labelled.count()
    if n > max_rows:
        labelled = labelled.filter(part < int(1_000_000 * max_rows / n))
    k = len(NAMES)
    moments = stats.agg(*[f(F.col("x")[i]).alias(f"{g}{i}") for i in range(k) for f, g in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    r = np.random.default_rng(SEED)
    mean, sd = (np.array([moments[f"{g}{i}"] or 0.0 for i in range(k)]) for g in "ms")
    model = {"mean": mean, "sd": np.where(sd > 1e-9, sd, 1.0), "w": r.normal(0, 1 / WIDTH, (k, FEATURES)), "b": r.uniform(0, 2 * math.pi, FEATURES)}
    rows = cut(stats.join(labelled, "doc_id").withColumn("held", F.pmod(part, F.lit(5)) == 0).repartition(PARTS))
    seen = rows.groupBy("y").count().collect()
    if len(seen) < 2:
        return None
    d = FEATURES + 2
    a = np.zeros((d, d))
    for i, j, v in _sums(rows.filter("NOT held"), model).collect():
        a[i, j] = a[j, i] = v
    if not a[-2, -2]:
        return None
    model["beta"] = np.linalg.solve(a[:-1, :-1] + RIDGE * np.eye(d - 1) * max(1.0, a[-2, -2] / 1000), a[:-1, -1])
    raw = rows.filter("held").mapInPandas(_scorer(model, "y"), "score double, y int")
    bins = raw.groupBy(F.floor((F.col("score") + 0.5) * (BINS / 2)).alias("bin")).agg(F.avg("score").alias("s"), F.sum("y").alias("y"), F.count("*").alias("n"))
    points = sorted((x["s"], float(x["y"]), float(x["n"])) for x in bins.collect())
    model["curve"] = pool_adjacent(points) if points else ([0.0, 1.0], [0.0, 1.0])
    return model


def _scorer(model: dict, beside: str = "doc_id"):
    """Scores, with the column beside of the row they belong to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            score = np.clip(fourier(np.array(f["x"].tolist()).reshape(-1, len(NAMES)), model) @ model["beta"], -0.5, 1.4999)
            if "curve" in model:
                score = np.clip(np.interp(score, *model["curve"]), 0, 1)
            yield pd.DataFrame({beside: f[beside], "score": score})

    return run


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds, F.lit(0))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_LABELLED) -> DataFrame:
    """doc_id, score and predicted for every row of docs (doc_id bigint, text); labels: doc_id, y (0 or 1).

    Null and empty texts are scored, as texts with no words; without labels of both kinds every
    score is 0.5; repeated rows score alike; a null id is scored and carried as it is; an empty table gives no rows. The text is the only
    input of a score.
    """
    stats = cut(map_batches(docs.select("doc_id", "text"), _stats_of, "doc_id bigint, x array<double>"))
    known = labels.filter("y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    model = fit(stats, known, max_rows)
    if model is None:
        scored = stats.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = exact(stats, "doc_id bigint, score double", lambda rows, kinds: rows.mapInPandas(_scorer(model), kinds))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("quality").cast("int").alias("y"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    out = score(read(spark, sf_dir, "documents", "doc_id", "text"), learning_labels(read(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
