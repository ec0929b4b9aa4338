r"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of BUCKETS hashed words over all documents.
2. Randomised SVD of the TF-IDF matrix of the benchmark's passages, all of them (WINDOW words, every
   STRIDE): each partition multiplies its own rows, products are summed bucket by bucket, and the
   driver only orthonormalises a BUCKETS x (RANK + EXTRA) matrix. The space is that of what is
   looked for; documents are folded in, so words that no item has only make a passage longer.
3. Every passage of every document against every passage of the benchmark, in latent cosine:
   blocks of items meet blocks of passages as matrix products in the scan, without a shuffle. A
   passage is measured by its whole length, not only by what the basis keeps, and by what an
   item's passage keeps of itself: a verbatim copy scores 1, unrelated text near 0.
4. Candidates that share SHARED of an item passage's words, weighed by idf, go on to the longest
   common subsequence of words around the passage: an item is leaked if it covers SURE of the
   item, or from LIKELY on if the item's last sentence (its answer) is there too. Tests measure
   steps 3 and 4 against the same rule at every place of every document.

A pass over the documents looks for ITEMS_AT_ONCE items at most, so what is sent to the tasks is
bounded; a larger benchmark takes more passes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut
from textloom.llm.vectext import bound_batches, map_batches, word_hashes

BUCKETS = 1 << 13
WINDOW, STRIDE, ITEM_STRIDE = 16, 8, 4
RANK, EXTRA, POWER = 128, 8, 2
PARTS = 8
COSINE = 0.3
SHARED = 0.4
SURE, LIKELY, ANSWER = 0.8, 0.6, 0.8
ITEMS_AT_ONCE = 2000
SEED = 3
CHUNK, COLUMNS, PAIRS, SPAN = 2048, 2048, 1 << 14, 1 << 15

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = re.compile(r"^\W+|\W+$")


def buckets(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(BUCKETS - 1)).astype(np.int32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """df by bucket over all documents, and their number: BUCKETS rows come to the driver."""
    bound_batches(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for f in frames:
            words = word_hashes(list(f["text"]))
            doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
            if len(doc):
                pairs = np.unique(doc * BUCKETS + buckets(np.concatenate(words)))
                total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
            n += len(f)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(some, -1), "df": np.append(total[some], n)})

    rows = docs.select("text").mapInPandas(run, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS)
    n = 0
    for b, v in rows:
        if b < 0:
            n = v
        else:
            df[b] = v
    return df, n


def blocks_of(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token buckets in rows of STRIDE (padded with BUCKETS), and for each passage its first block and whether
    a second follows in its document. A passage is WINDOW = 2 * STRIDE words, less at a document's end."""
    counts = np.array([-(-len(w) // STRIDE) for w in words])
    tokens = np.full(int(counts.sum()) * STRIDE, BUCKETS, np.int32)
    at = 0
    for w, c in zip(words, counts, strict=True):
        tokens[at : at + len(w)] = buckets(w)
        at += c * STRIDE
    ends = np.cumsum(counts)
    doc = np.repeat(np.arange(len(words)), counts)
    last = np.zeros(len(doc), bool)
    last[ends[counts > 0] - 1] = True
    return tokens.reshape(-1, STRIDE), doc, last


def passages(tokens: np.ndarray, last: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the rows of table (BUCKETS + 1 of them, the last zero) over each passage's words."""
    block = np.empty((len(tokens), table.shape[1]), np.float32)
    row = np.empty((CHUNK, table.shape[1]), np.float32)
    for i in range(0, len(tokens), CHUNK):
        here, out = tokens[i : i + CHUNK], block[i : i + CHUNK]
        np.take(table, here[:, 0], axis=0, out=out, mode="clip")
        for j in range(1, here.shape[1]):  # word by word, so that what is added stays in the cache
            out += np.take(table, here[:, j], axis=0, out=row[: len(here)], mode="clip")
    out = block.copy()
    out[:-1] += block[1:] * ~last[:-1, None]
    return out


def _padded(table: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.vstack([table, np.zeros((1, table.shape[1]))]), np.float32)  # rows are what is read


def gram_product(sample: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A^T (A right) for the passages A of sample (words: array<bigint>), summed over partitions."""
    table = _padded(idf[:, None] * right)
    width, step = right.shape[1], 512

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BUCKETS + 1, width))
        for f in frames:
            tokens, _, last = blocks_of([np.asarray(w, np.int64).view(np.uint64) for w in f["words"]])
            if not len(tokens):
                continue
            p = passages(tokens, last, table)
            # a block's words belong to the passage it begins and to the one before it
            both = p.copy()
            both[1:] += p[:-1] * ~last[:-1, None]
            flat = tokens.ravel()
            order = np.argsort(flat, kind="stable")
            keys, first = np.unique(flat[order], return_index=True)
            for k in range(0, len(keys), step):
                lo, hi = first[k], first[k + step] if k + step < len(keys) else len(flat)
                total[keys[k : k + step]] += np.add.reduceat(both[order[lo:hi] // STRIDE], first[k : k + step] - lo, axis=0)
        total = total[:BUCKETS] * idf[:, None]
        yield pd.DataFrame({"part": np.arange(BUCKETS // step), "v": [total[i : i + step].ravel() for i in range(0, BUCKETS, step)]})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": f["part"][:1], "v": [np.sum(np.stack(f["v"].to_list()), axis=0)]})

    # PARTS rows a group at most
    rows = sample.mapInPandas(run, "part int, v array<double>").groupBy("part").applyInPandas(add, "part int, v array<double>")
    out = np.zeros((BUCKETS, width))
    for part, v in rows.toLocalIterator():
        out[part * step : (part + 1) * step] = np.asarray(v).reshape(step, width)
    return out


def fit(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> np.ndarray:
    """BUCKETS x (rank + 1): idf times the right singular vectors, and idf squared; what a word adds to
    a passage's latent vector and to its squared length. idf is that of all documents, the vectors
    those of all items."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1

    def words(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"words": [w.view(np.int64) for w in word_hashes(list(f["text"]))]})

    items = cut(map_batches(benchmark.select("text"), words, "words array<bigint>").repartition(PARTS))
    q = np.random.default_rng(SEED).normal(size=(BUCKETS, rank + EXTRA))
    for _ in range(POWER):
        q, _ = np.linalg.qr(gram_product(items, idf, q))
    # of the small matrix Q^T (A^T A) Q the eigenvectors turn Q into singular vectors
    _, turn = np.linalg.eigh(q.T @ gram_product(items, idf, q))
    return _padded(np.hstack([idf[:, None] * (q @ turn[:, ::-1][:, :rank]), (idf**2)[:, None]]))


def item_windows(words: np.ndarray) -> list[np.ndarray]:
    """Buckets of an item's passages, every ITEM_STRIDE words; a short item is one."""
    b = buckets(words)
    top = max(0, len(b) - WINDOW)
    return [b[min(s, top) :][:WINDOW] for s in range(0, top + ITEM_STRIDE, ITEM_STRIDE)]


def targets_of(windows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """Columns whose product with a passage's latent vector, by its whole length, is 1 for a verbatim copy."""
    x = np.array([table[b].sum(axis=0) for b in windows])
    latent, length = x[:, :-1], np.sqrt(x[:, -1:])
    kept = (latent**2).sum(axis=1, keepdims=True)
    return (latent * length / np.where(kept > 1e-9, kept, 1)).T.astype(np.float32)


@lru_cache(maxsize=1 << 16)
def plain_word(w: str) -> str:
    return _EDGES.sub("", w.lower()) or w


def plain(words: list[str]) -> list[str]:
    """Lower-cased, without marks at the ends; a word of marks only stays."""
    return list(map(plain_word, words))


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for w in b:
        if hit := row & places.get(w, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def answer_of(text: str) -> list[str]:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if _WORD.search(s)]
    return plain(_WORD.findall(sentences[-1])) if sentences else []


def searcher(items: list[tuple[int, str]], table: np.ndarray, cosine: float, sure: float, likely: float):
    known = [(i, t, h) for (i, t), h in zip(items, word_hashes([t for _, t in items]), strict=True) if len(h)]
    # what a word weighs, idf squared
    weight = table[:, -1]
    each = [(np.float32(SHARED * weight[w].sum() * 0.9999), k, w) for k, (_, _, h) in enumerate(known) for w in item_windows(h)]  # sums differ by their order
    each.sort(key=lambda x: x[:2])
    windows, owner = [w for _, _, w in each], np.array([k for _, k, _ in each], np.int64)
    enough = np.array([e for e, _, _ in each], np.float32)
    targets = targets_of(windows, table) if windows else np.zeros((table.shape[1] - 1, 0), np.float32)
    spelled, weights = np.full((len(windows), WINDOW), -1, np.int16), np.zeros((len(windows), WINDOW), np.float32)
    in_items = np.zeros_like(weight)
    for k, w in enumerate(windows):
        spelled[k, : len(w)], weights[k, : len(w)] = w, weight[w]
        in_items[w] = weight[w]
    texts = [(plain(_WORD.findall(t)), answer_of(t)) for _, t, _ in known]

    def shares_words(tokens: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Whether passages (rows of buckets) have enough of the words of the items' passages k, by weight."""
        words = spelled[k]
        there = words == tokens[:, :1]
        for j in range(1, tokens.shape[1]):
            there |= words == tokens[:, j : j + 1]
        return np.einsum("ij,ij->i", weights[k], there) >= enough[k]

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        tokens, doc, last = blocks_of(word_hashes(list(frame["text"])))
        first_block = np.searchsorted(doc, np.arange(len(frame)))
        found: dict[tuple[int, int], dict[int, float]] = {}
        scores = np.empty(CHUNK * min(COLUMNS, targets.shape[1]), np.float32)
        follows = np.full_like(tokens, BUCKETS)
        follows[:-1][~last[:-1]] = tokens[1:][~last[:-1]]
        # a span has the block after its last too, so that passages end where they should
        for at in range(0, len(tokens) if targets.size else 0, SPAN):
            p = passages(tokens[at : at + SPAN + 1], last[at : at + SPAN + 1], table)[:SPAN]
            both = np.hstack([tokens[at : at + SPAN], follows[at : at + SPAN]]).astype(np.int16)
            # the most that a passage can share; in its order, so that items' passages that ask for more are left out
            most = in_items[both].sum(axis=1)
            order = np.argsort(most)
            for tile in range(int(np.searchsorted(most[order], enough[0])), len(order), CHUNK):
                rows = order[tile : tile + CHUNK]
                latent = p[rows, :-1] / np.sqrt(np.maximum(p[rows, -1:], 1e-9))
                wanted = int(np.searchsorted(enough, most[rows[-1]], "right"))
                for column in range(0, wanted, COLUMNS):
                    block = targets[:, column : min(wanted, column + COLUMNS)]
                    c = np.matmul(latent, block, out=scores[: len(latent) * block.shape[1]].reshape(len(latent), -1))
                    hits = np.flatnonzero(c >= cosine)
                    for part in range(0, len(hits), PAIRS):
                        flat = hits[part : part + PAIRS]
                        r, k = flat // c.shape[1], flat % c.shape[1] + column
                        good = shares_words(both[rows[r]], k)
                        for r_, k_, c_ in zip((rows[r[good]] + at).tolist(), k[good].tolist(), c.ravel()[flat[good]].tolist(), strict=True):
                            places = found.setdefault((int(doc[r_]), int(owner[k_])), {})
                            places[r_] = max(places.get(r_, 0.0), min(1.0, c_))
        rows, split = [], (-1, [])
        ids, texts_in = list(frame["doc_id"]), list(frame["text"])
        for (d, k), hits in sorted(found.items()):
            item, answer = texts[k]
            best = (False, 0.0, 0.0)
            for block, c in sorted(hits.items()):
                s = (block - int(first_block[d])) * STRIDE
                lo, hi = max(0, s - len(item)), s + WINDOW + len(item)
                if split[0] != d:
                    split = d, _WORD.findall(texts_in[d])
                near = plain(split[1][lo:hi])
                # words of the item that are near at all bound the subsequence
                if sum(map(set(near).__contains__, item)) < likely * len(item):
                    continue
                share = lcs(item, near) / len(item)
                here = share >= sure or (share >= likely and lcs(answer, near) >= ANSWER * len(answer))
                best = max(best, (here, share, c))  # a place that meets the rule before one that doesn't
                if share == 1.0:
                    break
            if best[0]:
                rows.append((ids[d], known[k][0], best[2], best[1]))
        return pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs"])

    return fn


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, sure: float = SURE, likely: float = LIKELY, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs): a row for each document and item it gives away.

    docs: doc_id bigint, text; benchmark: item_id bigint, text. Null, empty and blank texts, of
    documents or items, leak nothing; rows without an id are found and share the null; repeated rows and ties give one row a pair; empty tables
    give no rows.
    """
    table = fit(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), rank)
    items = ((r["item_id"], r["text"]) for r in benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator())
    out = None
    while block := list(islice(items, ITEMS_AT_ONCE)):
        part = map_batches(docs.select("doc_id", "text"), searcher(block, table, cosine, sure, likely), "doc_id bigint, item_id bigint, cosine double, lcs double", ("doc_id", "item_id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, lcs double")
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    return leaks(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
