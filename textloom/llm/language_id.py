r"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs, left to right and right to left, read a text's bytes; a softmax over both states
labels every position, and a document's probabilities are the mean of its positions' log
probabilities, normalised. Trained here in numpy by backpropagation through time (Adam,
cross-entropy at every position).

A text is read whole, in stretches of LENGTH bytes side by side, each preceded and followed by
CONTEXT bytes of its neighbours, so that a step is one matrix product over many stretches and
no position lacks context. Gates come from a table by byte (the input has 256 values) plus the
recurrent product. Learning uses about FIT_STRETCHES stretches, in equal parts by language, which a
hash picks from all stretches of all learning documents, short texts and last stretches included
(what they lack isn't counted); every document is then labelled in full.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.quality_classifier import fold
from textloom.llm.vectext import map_batches

HIDDEN, EMBEDDING = 8, 8
LENGTH, CONTEXT = 96, 8
#: Bound of the learning sample: stretches of LENGTH bytes over all languages.
FIT_STRETCHES = 12_000
STEPS, BATCH, SPAN, RATE = 420, 192, 48, 0.02
SEED = 23
ROWS_AT_ONCE = 2048
UNKNOWN = "und"
PAD = 0  # what is read before a text and after it


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """Names of one direction's weights: input table wx (256 x 3H), recurrent wh (H x 3H), bias bn of the candidate."""

    def __init__(self, side: str):
        self.wx, self.wh, self.bn = f"{side}x", f"{side}h", f"{side}b"


LEFT, RIGHT = Direction("l"), Direction("r")


def new_model(classes: int, seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    m: dict[str, np.ndarray] = {"e": r.normal(0, 0.5, (256, EMBEDDING))}
    for d in (LEFT, RIGHT):
        m[d.wx] = r.normal(0, EMBEDDING**-0.5, (EMBEDDING, 3 * HIDDEN))
        m[d.wh] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN))
        m[d.bn] = np.zeros(3 * HIDDEN)
    m["o"] = r.normal(0, 0.3, (2 * HIDDEN, classes))
    m["c"] = np.zeros(classes)
    return m


def _forward(m: dict, d: Direction, bytes_: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) and what the backward pass needs. bytes_: (T, B), in reading order."""
    t, b = bytes_.shape
    h, H = np.zeros((b, HIDDEN)), HIDDEN
    states, kept = np.empty((t, b, H)), []
    table = m["e"] @ m[d.wx] + m[d.bn]
    for i in range(t):
        x, u = table[bytes_[i]], h @ m[d.wh]
        r, z = _sigmoid(x[:, :H] + u[:, :H]), _sigmoid(x[:, H : 2 * H] + u[:, H : 2 * H])
        n = np.tanh(x[:, 2 * H :] + r * u[:, 2 * H :])
        kept.append((h, r, z, n, u[:, 2 * H :]))
        h = n + z * (h - n)
        states[i] = h
    return states, kept


def _backward(m: dict, d: Direction, bytes_: np.ndarray, kept: list, grad: np.ndarray, g: dict) -> None:
    """Backpropagation through time; grad: of the loss by state (T, B, H); adds to g."""
    H = HIDDEN
    dh = np.zeros_like(grad[0])
    dtable = np.zeros((256, 3 * H))
    for i in range(len(kept) - 1, -1, -1):
        h, r, z, n, un = kept[i]
        dh = dh + grad[i]
        dn, dz = dh * (1 - z), dh * (h - n)
        an = dn * (1 - n * n)
        da = np.hstack([an * un * r * (1 - r), dz * z * (1 - z), an])
        du = np.hstack([da[:, : 2 * H], an * r])
        np.add.at(dtable, bytes_[i], da)
        g[d.wh] += h.T @ du
        dh = dh * z + du @ m[d.wh].T
    g["e"] += dtable @ m[d.wx].T
    g[d.wx] += m["e"].T @ dtable
    g[d.bn] += dtable.sum(axis=0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_and_gradient(m: dict, bytes_: np.ndarray, labels: np.ndarray, valid: np.ndarray | None = None) -> tuple[float, dict]:
    """Mean cross-entropy over all positions of (T, B) bytes, or those that valid marks, with a label for each of B, and its gradient."""
    t, b = bytes_.shape
    back = bytes_[::-1]
    fs, fk = _forward(m, LEFT, bytes_)
    bs, bk = _forward(m, RIGHT, back)
    both = np.concatenate([fs, bs[::-1]], axis=2)
    p = _softmax(both @ m["o"] + m["c"])
    weight = np.ones((t, b)) if valid is None else valid.astype(float)
    weight /= max(1.0, weight.sum())
    loss = (-np.log(p[:, np.arange(b), labels] + 1e-12) * weight).sum()
    dp = p.copy()
    dp[:, np.arange(b), labels] -= 1
    dp *= weight[:, :, None]
    g = {k: np.zeros_like(v) for k, v in m.items()}
    g["o"] += np.tensordot(both, dp, ((0, 1), (0, 1)))
    g["c"] += dp.sum(axis=(0, 1))
    ds = dp @ m["o"].T
    _backward(m, LEFT, bytes_, fk, ds[:, :, :HIDDEN], g)
    _backward(m, RIGHT, back, bk, ds[::-1, :, HIDDEN:], g)
    return float(loss), g


def train(stretches: np.ndarray, valid: np.ndarray, labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """stretches: (N, T) bytes, of which each step takes SPAN from a random place; valid: which exist. Adam with a rate that falls to a tenth."""
    m = new_model(classes, seed)
    r = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for s in range(1, steps + 1):
        pick = r.integers(0, len(stretches), min(BATCH, len(stretches)))
        at = r.integers(0, max(1, stretches.shape[1] - SPAN + 1))
        _, g = loss_and_gradient(m, stretches[pick, at : at + SPAN].T, labels[pick], valid[pick, at : at + SPAN].T)
        rate = RATE * (1 - 0.9 * s / steps)
        for k in m:
            mean[k] = 0.9 * mean[k] + 0.1 * g[k]
            square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
            m[k] = m[k] - rate * (mean[k] / (1 - 0.9**s)) / (np.sqrt(square[k] / (1 - 0.99**s)) + 1e-8)
    return m


class Reader:
    """The trained network in single precision, features by rows, for many stretches at once."""

    def __init__(self, m: dict[str, np.ndarray]):
        f = np.float32
        half = np.ones(3 * HIDDEN)
        half[: 2 * HIDDEN] = 0.5  # gates are sigmoids, taken as tanh of half the sum
        self.tables = [((m["e"] @ m[d.wx] + m[d.bn]) * half).astype(f) for d in (LEFT, RIGHT)]
        self.recurrent = [np.ascontiguousarray((m[d.wh] * half).T.astype(f)) for d in (LEFT, RIGHT)]
        self.out = [np.ascontiguousarray(m["o"][i * HIDDEN : (i + 1) * HIDDEN].T.astype(f)) for i in (0, 1)]
        self.bias = m["c"].astype(f)[:, None]

    def _run(self, side: int, columns: np.ndarray, order: range) -> dict[int, np.ndarray]:
        H, n = HIDDEN, columns.shape[1]
        h = np.zeros((H, n), np.float32)
        table, recurrent, out = self.tables[side], self.recurrent[side], self.out[side]
        u, gates, cand = np.empty((3 * H, n), np.float32), np.empty((2 * H, n), np.float32), np.empty((H, n), np.float32)
        logits = {}
        for t in order:
            x = table[columns[t]].T
            np.matmul(recurrent, h, out=u)
            np.add(x[: 2 * H], u[: 2 * H], out=gates)
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[:H], u[2 * H :], out=cand)
            cand += x[2 * H :]
            np.tanh(cand, out=cand)
            h -= cand
            h *= gates[H:]
            h += cand
            if CONTEXT <= t < CONTEXT + LENGTH:
                logits[t] = out @ h
        return logits

    def log_probabilities(self, stretches: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """(N, classes): sums over each stretch's labelled positions, those that valid (N, LENGTH) marks."""
        columns = np.ascontiguousarray(stretches.T)
        steps = range(columns.shape[0])
        left = self._run(0, columns, steps[: CONTEXT + LENGTH])
        right = self._run(1, columns, steps[::-1][: CONTEXT + LENGTH])
        total = np.zeros((len(self.bias), columns.shape[1]), np.float32)
        marks = valid.T.astype(np.float32)
        for t in range(CONTEXT, CONTEXT + LENGTH):
            x = left[t] + right[t] + self.bias
            x -= x.max(axis=0)
            x -= np.log(np.exp(x).sum(axis=0))
            total += x * marks[t - CONTEXT]
        return total.T


def stretches_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes in rows of CONTEXT + LENGTH + CONTEXT, LENGTH apart, and which of the LENGTH exist."""
    n = -(-len(data) // LENGTH)
    b = np.full(n * LENGTH + 2 * CONTEXT, PAD, np.uint8)
    b[CONTEXT : CONTEXT + len(data)] = np.frombuffer(data, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(b, LENGTH + 2 * CONTEXT)[::LENGTH]
    return rows[:n], (np.arange(n * LENGTH) < len(data)).reshape(n, LENGTH)


def label(texts: list[str | None], reader: Reader) -> np.ndarray:
    """(len(texts), classes): sums of log probabilities over all positions, stretches of many texts at a time."""
    out = np.zeros((len(texts), len(reader.bias)))
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            rows, valid = np.concatenate([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])
            owner = np.repeat([w[0] for w in waiting], [len(w[1]) for w in waiting])
            np.add.at(out, owner, reader.log_probabilities(rows, valid))
            waiting.clear()
            size = 0

    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if not data:
            continue
        rows, valid = stretches_of(data)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            if size and size + min(len(rows) - at, ROWS_AT_ONCE) > ROWS_AT_ONCE:
                flush()
            waiting.append((i, rows[at : at + ROWS_AT_ONCE], valid[at : at + ROWS_AT_ONCE]))
            size += len(waiting[-1][1])
    flush()
    return out


def learning_sample(docs: DataFrame, fit_stretches: int = FIT_STRETCHES) -> list[tuple[bytes, str]]:
    """(bytes, lang) of about fit_stretches stretches of whole texts, languages in equal parts."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND text <> ''").filter(fold(F.col("doc_id"), 3) != 1)
    known = known.withColumn("n", F.ceil(F.octet_length("text") / LENGTH))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return []
    each = max(1, fit_stretches // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, each / n)).otherwise(share)
    picked = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("doc_id", i, F.lit(SEED)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    some = known.withColumn("share", share).select("doc_id", "lang", "text", F.explode(picked).alias("i"))
    some = some.select("doc_id", "i", "lang", F.substring(F.encode("text", "UTF-8"), (F.col("i") * LENGTH + 1).cast("int"), F.lit(LENGTH)).alias("b"))
    return [(bytes(r["b"]), r["lang"]) for r in some.orderBy("doc_id", "i", "b", "lang").limit(2 * fit_stretches).collect()]


def fit(docs: DataFrame, fit_stretches: int = FIT_STRETCHES, steps: int = STEPS) -> tuple[list[str], dict | None]:
    """The languages and the trained network; None if there are fewer than two languages."""
    sample = learning_sample(docs, fit_stretches)
    langs = sorted({lang for _, lang in sample})
    if len(langs) < 2:
        return langs, None
    stretches = np.full((len(sample), LENGTH), PAD, np.uint8)
    valid = np.zeros(stretches.shape, bool)
    for i, (data, _) in enumerate(sample):
        stretches[i, : len(data)] = np.frombuffer(data, np.uint8)
        valid[i, : len(data)] = True
    return langs, train(stretches, valid, np.array([langs.index(lang) for _, lang in sample]), len(langs), steps)


def identify(docs: DataFrame, fit_stretches: int = FIT_STRETCHES, steps: int = STEPS) -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language, 0 to 1) for every row of docs.

    docs: doc_id, text, lang. Null texts and texts without a letter are `und`, with score 0; with
    one learned language, or none, that one (or `und`) is every text's; ties go to the language
    that comes first; repeated rows are labelled alike; an empty table gives no rows.
    """
    langs, model = fit(docs.select("doc_id", "text", "lang"), fit_stretches, steps)
    reader = Reader(model) if model else None

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        texts = list(frame["text"])
        lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        best, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if lettered.any() and langs:
            if reader is None:
                best[lettered], score[lettered] = langs[0], 1.0
            else:
                used = [t if ok else None for t, ok in zip(texts, lettered, strict=True)]
                total = label(used, reader)[lettered]
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t, ok in zip(texts, lettered, strict=True) if ok])
                p = _softmax(total / size[:, None])
                k = p.argmax(axis=1)
                best[lettered], score[lettered] = np.array(langs, object)[k], p[np.arange(len(k)), k]
        return pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": best, "score": score})

    return map_batches(docs.select("doc_id", "text"), fn, "doc_id bigint, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    out = identify(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
