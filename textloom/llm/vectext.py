r"""Words of texts as 64-bit hashes, by numpy over whole byte buffers.

A word is a run of bytes other than \x20 and \x09-\x0D. Its hash is a polynomial in its bytes
modulo 2 ** 64, taken from prefix sums over the buffer, then mixed. Texts are handled in
pieces of about PIECE bytes cut at white space, so memory doesn't grow with a text's length
(but for its hashes, 8 bytes a word).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 18
#: What a worker gets at a time, at most: rows, and bytes (one row of more comes alone).
ROWS, BYTES = 400, 32 << 20
BASE = 0x9E3779B97F4A7C15 | 1
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors that place a word in a window.
PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)

_space = np.zeros(256, bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _piece(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of buf."""
    b = np.frombuffer(buf, np.uint8)
    word = np.empty(len(b) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_space[b], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((_lower[b].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return starts, mix(h + (ends - starts).astype(np.uint64) * M1)


def cut_points(data: bytes) -> Iterator[bytes]:
    """data in pieces, each but the last ending in white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and data[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield data[at:end]
        at = end


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """The hashes of each text's words in order, A-Z lower-cased; short texts share a buffer."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    pending: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if pending:
            buf = b" ".join(d for _, d in pending)
            starts, h = _piece(buf)
            ends = np.cumsum([len(d) + 1 for _, d in pending])
            at = np.searchsorted(starts, ends)
            for (i, _), a, b in zip(pending, [0, *at[:-1]], at, strict=True):
                out[i] = h[a:b]
            pending.clear()
            size = 0

    for i, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass") if t else b""
        if len(data) > PIECE:
            out[i] = np.concatenate([_piece(p)[1] for p in cut_points(data)])
        else:
            if size + len(data) > PIECE:
                flush()
            pending.append((i, data))
            size += len(data) + 1
    flush()
    return out


def windows(words: np.ndarray, k: int = 5) -> np.ndarray:
    """The hash of each run of k words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, np.uint64(width * 0x9E37 & 0xFFFF), np.uint64)
    for j in range(width):
        total += words[j : n - width + 1 + j] * PLACES[j]
    return mix(total)


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's bounds of an Arrow batch to ROWS and BYTES; stricter ones stay. They hold when a plan runs, so they aren't put back."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = str(conf.get(key)).lower()
        have = int(now.rstrip("b")) if now.rstrip("b").lstrip("-").isdigit() else most + 1
        if not 0 < have <= most:
            conf.set(key, most)


def exact(df: DataFrame, schema: str, apply, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """apply(df, schema), a map through pandas, with the ids (bigint) as text on the way: pandas would round them beside a null."""
    texts = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns})
    out = apply(texts, re.sub(rf"\b({'|'.join(ids)}) bigint", r"\1 string", schema))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ids if c in out.columns})


def map_batches(df: DataFrame, fn, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """mapInPandas of fn (one frame to one frame) over batches of ROWS rows and BYTES bytes, which bounds a worker's memory.

    ids: bigint columns, of df or the result, that fn gets and gives as text or None, so that they stay exact beside nulls.
    """
    bound_batches(df)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return exact(df, schema, lambda rows, kinds: rows.mapInPandas(run, kinds), ids)
