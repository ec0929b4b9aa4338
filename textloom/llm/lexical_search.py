r"""Ranked lexical search over a two-level quantised index.

The index is blocks of documents, made where the documents are read: for each term of a block the
documents that have it (`doc`), how often (`tf`), and the byte impact of each such posting. A
posting adds weight * u to a score, u = 10**9 * tf div (1000 * tf + 8 * m) < 10**6; its impact is u in
steps of STEP, rounded up, so a sum of weight * impact * STEP is never below the score, and
above it by less than STEP for each unit of weight.

A search adds the bytes of an item's terms over a block, takes the kth largest lower bound, or the kth
best score that the task has seen if that is more, and scores exactly, in 64-bit integers, every
document whose upper bound reaches it. What reaches it in its task goes to one top-k for all. Items come
in chunks; each chunk meets each block once.

A block holds at most DOCS documents and is closed when it has POSTINGS postings, so a task's memory
doesn't depend on the table; a long text's terms are counted piece by piece. Blocks are written to the
shared checkpoint folder, as three steps read them: sizes, document frequencies, the search.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, read, small
from textloom.llm.vectext import bound_batches

K = 10
DOCS, POSTINGS = 4096, 500_000
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20
#: 255 steps cover every u below 10**6.
STEP = 3922
#: Items a task takes at a time.
CHUNK = 1000

#: Bytes to term bytes: A-Z in lower case, other ASCII but digits and letters to spaces, the rest as it is.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_BLOCK = "n_docs bigint, n_terms bigint, ids binary, known binary, lengths binary, terms binary, starts binary, doc binary, tf binary"


def term_counts(text: bytes) -> Counter:
    """How often text has each term."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and _TERM[text[end]] != 32:
            end += 1
        counts.update(text[at:end].translate(_TERM).split())
        at = end
    return counts


def _binary(batch: pa.RecordBatch, column: int) -> pa.Array:
    return batch.column(column).cast(pa.large_binary())


class _Block:
    """Documents being gathered."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.vocabulary: dict[bytes, int] = {}
        self.term: list[np.ndarray] = []
        self.tf: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        v = self.vocabulary
        self.ids.append(doc_id)
        self.term.append(np.fromiter((v.setdefault(t, len(v)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.lengths.append(int(self.tf[-1].sum(dtype=np.int64)))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= DOCS or self.postings >= POSTINGS

    def row(self) -> pa.RecordBatch:
        term, tf = np.concatenate(self.term), np.concatenate(self.tf)
        doc = np.repeat(np.arange(len(self.ids), dtype=np.uint16), [len(t) for t in self.term])
        order = np.argsort(term, kind="stable")  # by term, then by document
        starts = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(self.vocabulary))))).astype(np.int32)
        values = {
            "n_docs": len(self.ids), "n_terms": sum(self.lengths), "ids": np.array([i or 0 for i in self.ids], np.int64).tobytes(),
            "known": np.array([i is not None for i in self.ids]).tobytes(), "lengths": np.array(self.lengths, np.int64).tobytes(),
            "terms": b" ".join(self.vocabulary), "starts": starts.tobytes(), "doc": doc[order].tobytes(), "tf": tf[order].tobytes(),
        }
        return pa.RecordBatch.from_pylist([values], schema=pa.schema([(k, pa.int64() if k.startswith("n_") else pa.binary()) for k in values]))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block()
    for b in batches:
        for doc_id, text in zip(b.column(0), _binary(b, 1), strict=True):
            if counts := term_counts(text.as_py() or b""):
                block.add(doc_id.as_py(), counts)
                if block.full():
                    yield block.row()
                    block = _Block()
    if block.ids:
        yield block.row()


def _us(tf: np.ndarray, lengths: np.ndarray, documents: int, words: int) -> np.ndarray:
    """u of postings in documents of these lengths, in 64-bit integers."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (100 - 90 + 90 * lengths * documents // words))


@dataclass(frozen=True)
class Index:
    """blocks, with the impacts; how many documents have a term, and all their terms with repeats."""

    blocks: DataFrame
    documents: int
    words: int


def build(docs: DataFrame) -> Index:
    """The index of every row of docs (doc_id, text and any more columns).

    A row without a term (null, empty, signs alone) is in no block and isn't counted. Rows that share an id,
    or have none, are documents of their own.
    """
    bound_batches(docs)
    raw = cut(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_gather, _BLOCK))
    sums = raw.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("w")).first()
    documents, words = int(sums.d), int(sums.w)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1)
                lengths, doc, tf = (np.frombuffer(row[c][0].as_buffer(), t) for c, t in (("lengths", np.int64), ("doc", np.uint16), ("tf", np.int32)))
                impact = (_us(tf, lengths[doc], documents, words) + (STEP - 1)) // STEP
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([impact.astype(np.uint8).tobytes()], pa.binary())], names=[*row.schema.names, "impact"])

    return Index(raw.mapInArrow(quantise, _BLOCK + ", impact binary"), documents, words)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for terms, starts in zip(b.column(0), b.column(1), strict=True):
            names = pa.array(terms.as_py().split(b" "), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.diff(np.frombuffer(starts.as_buffer(), np.int32)).astype(np.int64))], names=["term", "df"])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(i.as_py(), t.decode()) for i, text in zip(b.column(0), _binary(b, 1), strict=True) for t in term_counts(text.as_py() or b"")]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["item", "term"])


def weights(index: Index, terms: DataFrame) -> DataFrame:
    """terms (item, term) with the weight of each; those that no document has, or that weigh nothing, are left out."""
    asked = cut(terms.select("term").distinct())
    df = index.blocks.select("terms", "starts").mapInArrow(_frequencies, "term string, df bigint")
    df = cut(df.join(small(asked), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    return terms.join(small(df), "term").select("item", "term", w.cast("bigint").alias("w")).filter("w > 0")


class _Items:
    """A chunk of items as a task uses it: the best k scores that it has seen of each."""

    def __init__(self, chunk: list[dict], k: int) -> None:
        self.terms: dict[int, list[tuple[bytes, int]]] = {}
        for x in chunk:
            self.terms.setdefault(x["item"], []).append((x["term"].encode(), x["w"]))
        self.best = {i: np.zeros(k, np.int64) for i in self.terms}


def _in_block(block: dict, items: _Items, k: int, documents: int, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, documents by place in the block, scores) of what may be among an item's best k."""
    lengths, starts, doc, tf, impact = (np.frombuffer(block[c], t) for c, t in (("lengths", np.int64), ("starts", np.int32), ("doc", np.uint16), ("tf", np.int32), ("impact", np.uint8)))
    place = {t: n for n, t in enumerate(block["terms"].split(b" "))}
    for item, terms in items.terms.items():
        here = [(starts[n], starts[n + 1], w) for t, w in terms if (n := place.get(t)) is not None]
        if not here:
            continue
        bound = np.zeros(len(lengths), np.int64)
        for a, z, w in here:
            bound[doc[a:z]] += impact[a:z] * np.int64(w)
        bound *= STEP
        best = items.best[item]
        least = max(1, best.min())
        if len(bound) >= k:  # a score is above its bound less a step for each unit of weight
            least = max(least, np.partition(bound, -k)[-k] - (STEP - 1) * sum(w for _, _, w in here))
        may = np.flatnonzero(bound >= least)
        if not len(may):
            continue
        score = np.zeros(len(may), np.int64)
        for a, z, w in here:
            at = np.searchsorted(doc[a:z], may)
            has = at < z - a
            has[has] = doc[a:z][at[has]] == may[has]
            score[has] += w * _us(tf[a:z][at[has]], lengths[may[has]], documents, words)
        keep = score >= max(1, best.min())
        may, score = may[keep], score[keep]
        items.best[item] = np.sort(np.concatenate([best, score]))[-k:]
        yield item, may, score


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k highest-scoring documents with a score above 0; ties by id, a null id last.

    items: item_id, text and any more columns. An item without a term that some document has gets no rows. Rows that
    repeat an item's id and text are one item; of one id, or none, each text is an item of its own. Documents that
    tie in score and id are in any order. No items or no documents: no rows.
    """
    given = cut(items.select("item_id", "text").distinct().withColumn("item", F.monotonically_increasing_id()))
    weighed = cut(weights(index, cut(given.select("item", "text").mapInArrow(_item_terms, "item bigint, term string"))))
    chunks = max(1, -(-weighed.select("item").distinct().count() // CHUNK))
    packed = weighed.groupBy(F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int").alias("chunk")).agg(F.collect_list(F.struct("item", "term", "w")).alias("items"))
    documents, words = index.documents, index.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, _Items] = {}
        for b in batches:
            for i in range(len(b)):
                chunk = b["chunk"][i].as_py()
                if chunk not in seen:
                    seen[chunk] = _Items(b["items"][i].as_py(), k)
                row = {c: b[c][i].as_py() for c in b.schema.names if c not in ("chunk", "items")}
                ids, known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], bool)
                found = list(_in_block(row, seen[chunk], k, documents, words))
                if found:
                    at = np.concatenate([m for _, m, _ in found])
                    item = np.repeat([i for i, _, _ in found], [len(m) for _, m, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(item, pa.int64()), pa.array(ids[at], pa.int64(), mask=~known[at]), pa.array(np.concatenate([s for _, _, s in found]))], names=["item", "doc_id", "score"]
                    )

    columns = ["ids", "known", "lengths", "terms", "starts", "doc", "tf", "impact"]
    met = index.blocks.select(*columns, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).join(small(cut(packed), CHUNK), "chunk")
    hits = met.select("chunk", "items", *columns).mapInArrow(run, "item bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(small(given.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(build(read(spark, sf_dir, "documents", "doc_id", "text")), read(spark, sf_dir, "benchmark", "item_id", "text"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_SQL_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS n, sum(len(terms))::BIGINT AS l FROM d WHERE len(terms) > 0),
i AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, list_distinct({_SQL_TERMS}) AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS MATERIALIZED (SELECT item, unnest(terms) AS term FROM i),
p AS MATERIALIZED (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT item, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.terms) * n) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY item, r),
t AS (SELECT item, doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM t JOIN i USING (item) WHERE rank <= {K}
"""
