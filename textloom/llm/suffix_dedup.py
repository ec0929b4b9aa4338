r"""Exact repeated passages by a prefix-aware distributed merge sort of suffixes.

A byte goes if a string of SIZE bytes that covers it also starts anywhere else. Sorting every
suffix would move each text hundreds of times over, so suffixes are taken only at anchors:
positions whose hash of GRAM bytes is the least of all in some run of REACH bytes. Where an
anchor is depends on the bytes around it alone, so two equal strings of SIZE bytes have anchors
at the same places, one of them in their first REACH bytes. Hence:

1. Anchors whose next CORE = SIZE - REACH bytes occur once can't be in a repeat. They are counted
   by hash and left out; that leaves repeated text, whatever the corpus's size.
2. An anchor's context is REACH bytes before it and SIZE bytes from it. Equal contexts are one entry
   with a count, combined map-side, so that copies of a document are sorted once.
3. Entries are sorted by the bytes from the anchor. Each task sorts its own into runs, cuts them at
   sampled splitters and sends them front-coded (what a suffix shares with the one before isn't
   sent; of one whose core no other entry has, the core is enough); each range is merged by a
   loser tree over (suffix, common prefix with the last winner), which compares only beyond
   prefixes it knows. So each suffix comes with what it shares with its neighbour.
4. The merge settles every span. An entry counted twice or more is a repeat as far as its context
   goes. In a block that shares its core, contexts a and b with L common bytes before and R from the
   anchor hold a repeat if L + R >= SIZE; the union over all b is one span. Blocks of up to PAIRWISE
   entries are compared pair by pair, larger ones offset by offset, with one result.
5. A block is settled in one task, and one of more than LARGE entries is too much for that: it is
   parted by what strings of a few neighbouring offsets have in common, more than the core. What is
   alone with that drops out, the rest is settled as small blocks are, and parts that are still
   large are parted on, down to single strings. This is exact too; tests hold both ways against brute force.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, small
from textloom.llm.vectext import PIECE, bound_batches, map_batches, mix, powers

SIZE, REACH, GRAM = 400, 200, 16
PAIRWISE = 200
LARGE = 20_000
IN_RANGE = 20_000
#: Sampled cores for the splitters, at least, and for each range.
SAMPLE, SAMPLE_A_RANGE = 4000, 8
CHUNK_BYTES = 1 << 20
#: Offsets less one in a node of a large block, step by step, and the rows of nodes that a task holds at a time.
WIDTHS = (24, 4, 0)
NODE_ROWS = 10_000
KEY = "k1 bigint, k2 bigint"


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of width, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all strings of SIZE bytes in data, and the hash of CORE bytes from each."""
    width, starts = REACH - GRAM + 1, len(data) - SIZE + 1
    found: dict[int, int] = {}
    for at in range(0, max(0, starts), PIECE):
        n = min(PIECE, starts - at)
        b = np.frombuffer(data, np.uint8, min(len(data) - at, n - 1 + SIZE), at)
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        h = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(b) - GRAM + 1])[: n + width - 1]
        least = _sliding(h, width, np.minimum)  # one for each start
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        here = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
        core = SIZE - REACH
        hashes = mix((sums[here + core] - sums[here]) * down[here])
        found.update(zip((here + at).tolist(), hashes.tolist(), strict=True))
    p = np.array(sorted(found), np.int64)
    return p, np.array([found[i] for i in p.tolist()], np.uint64)


#: right, left, c1, c2, n, and the lengths of the whole context before the anchor and from it.
Entry = tuple[bytes, bytes, int, int, int, int, int]


def _encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _anchor_rows(f: pd.DataFrame) -> pd.DataFrame:
    rows = [(k1, k2, *anchors(_encoded(t))) for k1, k2, t in zip(f["k1"], f["k2"], f["text"], strict=True)]
    return pd.DataFrame([(a, b, p, h.view(np.int64)) for a, b, p, h in rows if len(p)], columns=["k1", "k2", "pos", "core"])


def context(data: bytes, at: int) -> tuple[bytes, bytes]:
    """Bytes before the anchor, nearest first, and from it."""
    return data[max(0, at - REACH) : at][::-1], data[at : at + SIZE]


def _member_rows(f: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for k1, k2, t, places, cores in zip(f["k1"], f["k2"], f["text"], f["pos"], f["core"], strict=True):
        data = _encoded(t)
        for p, core in zip(places, cores, strict=True):
            left, right = context(data, p)
            h = hashlib.blake2b(left + right, digest_size=16, salt=len(left).to_bytes(2, "little")).digest()
            rows.append((k1, k2, p, core, int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), len(left), len(right)))
    return pd.DataFrame(rows, columns=["k1", "k2", "pos", "core", "c1", "c2", "l", "r"])


def _entries(f: pd.DataFrame) -> Iterator[Entry]:
    """The entries of a batch of texts; one that is alone with its core has no more than that."""
    wanted = [f[c] for c in ("pos", "c1", "c2", "n", "l", "r", "kinds")]
    for t, *lists in zip(f["text"], *wanted, strict=True):
        data = _encoded(t)
        for at, c1, c2, n, l, r, kinds in zip(*(x.tolist() for x in lists), strict=True):
            left, right = context(data, at) if kinds > 1 else (b"", data[at : at + SIZE - REACH])
            yield right, left, c1, c2, n, l, r


def _cores(f: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"core": [e[0][: SIZE - REACH] for e in _entries(f)]})


# --- sorted runs, front coding, loser tree ---------------------------------------------------

HEAD = struct.Struct("<HHHHHqqq")


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be start at least."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    lo, hi = start, n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def front_code(run: list[Entry]) -> bytes:
    out, before = [], b""
    for right, left, c1, c2, n, l, r in run:
        k = common(before, right)
        out += HEAD.pack(k, len(right) - k, len(left), l, r, c1, c2, n), right[k:], left
        before = right
    return b"".join(out)


def front_decode(blob: bytes) -> Iterator[tuple[int, Entry]]:
    """(prefix shared with the entry before, entry)."""
    at, before, size = 0, b"", HEAD.size
    while at < len(blob):
        k, m, of_left, l, r, c1, c2, n = HEAD.unpack_from(blob, at)
        at += size
        before = before[:k] + blob[at : at + m]
        yield k, (before, blob[at + m : at + m + of_left], c1, c2, n, l, r)
        at += m + of_left


class LoserTree:
    """Merges sorted runs of (common prefix with the entry before, entry).

    Each contender carries what it shares with the last winner. Of two, the one that shares more is
    smaller without a look at the bytes; only equal ones are compared, from there on, and what
    they turn out to share goes to the loser.
    """

    def __init__(self, runs: list[Iterator[tuple[int, Entry]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.now: list[tuple[int, Entry] | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.now = [(0, x[1]) if x else None for x in self.now]
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix is then with the winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        p, q = x[1][0], y[1][0]
        k = common(p, q, x[0])
        if (p[k:], a) <= (q[k:], b):
            self.now[b] = (k, y[1])
            return a, b
        self.now[a] = (k, x[1])
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, Entry]]:
        while (top := self.now[self.winner]) is not None:
            yield top
            i = self.winner
            self.now[i] = next(self.runs[i], None) if i < len(self.runs) else None
            node = (i + self.size) // 2
            while node:
                i, self.losers[node] = self._play(i, self.losers[node])
                node //= 2
            self.winner = i


# --- blocks ----------------------------------------------------------------------------------


def _lefts(block: list[Entry]) -> np.ndarray:
    """Bytes before the anchors, in rows of REACH; what is missing equals nothing."""
    a = np.empty((len(block), REACH), np.int32)
    for i, e in enumerate(block):
        a[i, : len(e[1])] = np.frombuffer(e[1], np.uint8)
        a[i, len(e[1]) :] = 256 + i
    return a


def settle(block: list[Entry], lcp: list[int]) -> list[tuple[int, int, int, int]]:
    """(c1, c2, bytes before, bytes from the anchor) of each entry that holds a repeat.

    block: entries that share their core, sorted; lcp[i]: what i shares with i - 1.
    """
    m = len(block)
    # an entry that occurs again is a repeat as far as its context goes
    far, near = ([e[side] if e[4] > 1 and e[5] + e[6] >= SIZE else -1 for e in block] for side in (5, 6))
    if 1 < m <= PAIRWISE:
        for i in range(m - 1):
            right, left = SIZE, block[i][1]
            for j in range(i + 1, m):
                right = min(right, lcp[j])
                other, need = block[j][1], SIZE - right
                if need <= len(left) and left[:need] == other[:need]:
                    same = common(left, other, need)
                    far[i], far[j] = max(far[i], same), max(far[j], same)
                    near[i], near[j] = max(near[i], right), max(near[j], right)
    elif m > 1:
        _by_offset(block, lcp, far, near)
    return [(e[2], e[3], x, y) for e, x, y in zip(block, far, near, strict=True) if x >= 0]


def _by_offset(block: list[Entry], lcp: list[int], far: list[int], near: list[int]) -> None:
    m = len(block)
    a = _lefts(block)
    most, least = np.full(m, -1), np.full(m, -1)
    steps = np.asarray(lcp)
    steps[0] = SIZE
    by_left = np.zeros(m, np.int64)
    for d in range(REACH + 1):
        if d:
            _, by_left = np.unique(by_left * (1 << 32) + a[:, d - 1], return_inverse=True)
        by_right = np.cumsum(steps < SIZE - d)
        _, which, counts = np.unique(by_left.astype(np.int64) * m + by_right, return_inverse=True, return_counts=True)
        # a context that ends before the string does isn't equal to its neighbour: lcp is at most its length
        hit = counts[which] > 1
        most[hit] = d
        least[hit & (least < 0)] = d
    for i in np.flatnonzero(most >= 0).tolist():
        far[i], near[i] = max(far[i], int(most[i])), max(near[i], SIZE - int(least[i]))


def _merge_range(f: pd.DataFrame) -> pd.DataFrame:
    f = f.sort_values(["run", "part"])
    runs = [front_decode(blob) for blob in f["blob"]]  # every chunk is a run
    out: list[tuple[int, int, int, int]] = []
    block: list[Entry] = []
    lcp: list[int] = []
    seen: set[tuple[int, int]] = set()
    least = SIZE  # prefix shared since the last entry that was taken
    for k, entry in LoserTree(runs):
        if block and k < SIZE - REACH:
            out += settle(block, lcp)
            block, lcp, seen, least = [], [], set(), SIZE
        least = min(least, k)
        if entry[2:4] not in seen:  # rows that repeat give their entries in several runs
            seen.add(entry[2:4])
            block.append(entry)
            lcp.append(least)
            least = SIZE
    out += settle(block, lcp)
    return pd.DataFrame(out, columns=["c1", "c2", "before", "after"])


def wanted_sample(n: int) -> int:
    """Cores to sample of n entries: in proportion to the ranges, so that ranges stay as small however many entries there are."""
    return max(SAMPLE, SAMPLE_A_RANGE * -(-n // IN_RANGE))


def chosen(h: Column, wanted: int, n: int) -> Column:
    """Whether a row of this 64-bit hash is one of about `wanted` among n; in steps of 2 ** -62, so no share is too small."""
    return F.pmod(h, F.lit(2**62)) < F.lit(min(2**62, 2**62 * wanted // max(n, 1)))


def sorted_spans(texts: DataFrame, sample: list[bytes], n: int) -> DataFrame:
    """(c1, c2, before, after) of the n entries of texts (text; pos, c1, c2, n, l, r, kinds: arrays), by merge sort.

    sample: cores for the splitters, as wanted_sample() has it: entries that share one are settled together.
    """
    ranges = max(1, -(-n // IN_RANGE))
    sample = sorted(sample)
    splitters = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows: list[Entry] = []
        run = TaskContext.get().partitionId()
        part = 0

        def spill() -> pd.DataFrame:
            nonlocal part
            rows.sort(key=lambda e: (e[0], e[2], e[3]))
            rows[1:] = [e for e, d in zip(rows[1:], rows, strict=False) if e[2:4] != d[2:4]]
            out, start = [], 0
            where = [bisect_right(splitters, e[0][: SIZE - REACH]) for e in rows]
            while start < len(rows):
                end = start
                while end < len(rows) and end - start < CHUNK_BYTES // SIZE and where[end] == where[start]:
                    end += 1
                out.append((where[start], run, part, front_code(rows[start:end])))
                part += 1
                start = end
            rows.clear()
            return pd.DataFrame(out, columns=["range", "run", "part", "blob"])

        for f in frames:
            for e in _entries(f):
                rows.append(e)
                if len(rows) >= 50_000:
                    yield spill()
        yield spill()

    coded = texts.mapInPandas(runs, "range int, run int, part int, blob binary")
    return coded.groupBy("range").applyInPandas(_merge_range, "c1 bigint, c2 bigint, before int, after int")


#: A node: entries of a large block that share the bytes of key h1, h2, `lo` before the anchor and SIZE - lo - width from it.
#: left, right: the `width` bytes that follow on either side. Its strings start lo to lo + width bytes before the anchor.
NODE = "c1 bigint, c2 bigint, lo int, h1 bigint, h2 bigint, left binary, right binary"
Node = tuple[int, int, int, int, int, bytes, bytes]


def _frames(rows: Iterator[Node]) -> Iterator[pd.DataFrame]:
    """rows in frames of NODE_ROWS, whatever a text or node has of them."""
    names = [c.split()[0] for c in NODE.split(", ")]
    while some := list(islice(rows, NODE_ROWS)):
        yield pd.DataFrame(some, columns=names)


def narrower(node: Node, width: int, new: int) -> Iterator[Node]:
    """A node of `width` as nodes of the new width, which have all its offsets between them. Those that the context doesn't reach are left out."""
    c1, c2, lo, h1, h2, left, right = node
    key = struct.pack("<qq", h1, h2)
    steps = list(range(0, width - new + 1, new + 1))
    if steps[-1] < width - new:
        steps.append(width - new)
    for a in steps:
        b = width - new - a
        if a <= len(left) and b <= len(right):
            h = hashlib.blake2b(left[:a] + right[:b] + key, digest_size=16, salt=(lo + a).to_bytes(2, "little")).digest()
            yield (c1, c2, lo + a, *struct.unpack("<qq", h), left[a : a + new], right[b : b + new])


def first_nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of WIDTHS[0] of the entries of texts."""

    def rows() -> Iterator[Node]:
        for f in frames:
            for right, left, c1, c2, *_ in _entries(f):
                core = hashlib.blake2b(right[: SIZE - REACH], digest_size=16).digest()
                yield from narrower((c1, c2, 0, *struct.unpack("<qq", core), left, right[SIZE - REACH :]), REACH, WIDTHS[0])

    return _frames(rows())


def _padded(pieces: pd.Series, width: int) -> np.ndarray:
    """Rows of `width` bytes; what is missing equals nothing."""
    a = np.empty((len(pieces), width), np.int64)
    for i, x in enumerate(pieces):
        a[i, : len(x)] = np.frombuffer(x, np.uint8)
        a[i, len(x) :] = 256 + i
    return a


def settler(width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda f: settle_nodes(f, width)


def settle_nodes(f: pd.DataFrame, width: int) -> pd.DataFrame:
    """(c1, c2, before, after) of the entries in f that hold a repeat; f has whole nodes of one width."""
    m = len(f)
    left, right = _padded(f["left"], width), _padded(f["right"], width)
    same = [f.groupby(["h1", "h2"]).ngroup().to_numpy().astype(np.int64)]  # for each number of bytes on the right
    for i in range(width):
        same.append(np.unique(same[-1] * (1 << 32) + right[:, i], return_inverse=True)[1].astype(np.int64))
    most, least, by_left = np.full(m, -1), np.full(m, -1), np.zeros(m, np.int64)
    for d in range(width + 1):
        if d:
            by_left = np.unique(by_left * (1 << 32) + left[:, d - 1], return_inverse=True)[1].astype(np.int64)
        _, which, counts = np.unique(by_left * m + same[width - d], return_inverse=True, return_counts=True)
        hit = counts[which] > 1
        most[hit] = d
        least[hit & (least < 0)] = d
    f = f[["c1", "c2", "lo"]].assign(before=f["lo"] + most, after=SIZE - f["lo"] - least)
    return f.loc[most >= 0, ["c1", "c2", "before", "after"]]


def counted_spans(texts: DataFrame, entries: DataFrame, large: int) -> DataFrame:
    """The same for the entries of cores with very many: by nodes of fewer and fewer offsets.

    A node that an entry has alone holds no match. Nodes of up to `large` entries are settled, many in
    one task; larger ones go on to narrower ones, and at width 0 all of a node is one string.
    """
    # an entry that occurs again is a repeat as far as its context goes
    found = entries.filter((F.col("n") > 1) & (F.col("l") + F.col("r") >= SIZE)).select("c1", "c2", F.col("l").alias("before"), F.col("r").alias("after"))
    bound_batches(texts)
    rows = cut(texts.mapInPandas(first_nodes, NODE))
    for width, new in zip(WIDTHS, [*WIDTHS[1:], None], strict=True):
        shared = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("k")).filter("k > 1"))
        kept = rows.join(shared, ["h1", "h2"])
        if new is None:
            found = found.unionByName(kept.select("c1", "c2", F.col("lo").alias("before"), (F.lit(SIZE) - F.col("lo")).alias("after")))
            break
        few, many = shared.agg(*[F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)) for c in (F.col("k") <= large, F.col("k") > large)]).first()
        if few:
            task = F.pmod("h1", F.lit(-(-few // IN_RANGE)))
            settled = kept.filter(F.col("k") <= large).drop("k").groupBy(task).applyInPandas(settler(width), "c1 bigint, c2 bigint, before int, after int")
            found = found.unionByName(cut(settled))
        if not many:
            break

        def go_on(frames: Iterator[pd.DataFrame], width: int = width, new: int = new) -> Iterator[pd.DataFrame]:
            return _frames(x for f in frames for node in f.itertuples(index=False, name=None) for x in narrower(node, width, new))

        rows = cut(kept.filter(F.col("k") > large).select(*rows.columns).mapInPandas(go_on, NODE))
    return found.groupBy("c1", "c2").agg(F.max("before").alias("before"), F.max("after").alias("after"))


# --- the whole -------------------------------------------------------------------------------


def repeated_spans(docs: DataFrame, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(documents that may hold repeats, as docs; spans: k1, k2, from, to in bytes). docs: doc_id, k1, k2, text.

    What a join takes from an aggregation is written first: its other side is then dealt by a shuffle
    of its own, whose large partitions Spark splits, so that a core, context or row that a third of
    all places share doesn't land in one task.
    """
    found = cut(map_batches(docs.select("k1", "k2", "text"), _anchor_rows, f"{KEY}, pos array<bigint>, core array<bigint>"))
    places = found.select("k1", "k2", F.explode(F.arrays_zip("pos", "core")).alias("x")).select("k1", "k2", "x.pos", "x.core")
    often = cut(places.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1").select("core"))
    some = places.join(often, "core").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "core")).alias("p"))
    some = cut(some.select("k1", "k2", F.col("p.pos").alias("pos"), F.col("p.core").alias("core")))
    del found, places, often
    held = cut(docs.join(some, ["k1", "k2"]).select("doc_id", "k1", "k2", "text", "pos", "core"))
    del some
    members = cut(map_batches(held.drop("doc_id"), _member_rows, f"{KEY}, pos bigint, core bigint, c1 bigint, c2 bigint, l int, r int"))
    classes = cut(
        members.groupBy("c1", "c2").agg(
            F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"), F.first("core").alias("core"), F.first("l").alias("l"), F.first("r").alias("r")
        )
    )
    cores = cut(classes.groupBy("core").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    counted = cores.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("kinds") > large, F.col("kinds"))), F.lit(0))).first()
    n, n_big = classes.count(), counted[1]
    entries = cut(classes.join(cores, "core", "left").select("c1", "c2", "n", "at", "l", "r", F.coalesce("kinds", F.lit(1)).alias("kinds")))
    del classes, cores
    lists = ["pos", "c1", "c2", "n", "l", "r", "kinds"]

    def texts_of(chosen: DataFrame, few: bool = False) -> DataFrame:
        """The texts that entries are taken from, with the entries. Rows that repeat give theirs again; the sort drops those."""
        wanted = chosen.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct(F.col("at.pos").alias("pos"), *lists[1:])).alias("w"))
        wanted = wanted.select("k1", "k2", *[F.col("w")[c].alias(c) for c in lists])
        return held.select("k1", "k2", "text").join(small(cut(wanted)) if few else cut(wanted), ["k1", "k2"]).select("text", *lists)

    sample = map_batches(texts_of(entries.filter(chosen(F.xxhash64("c1", "c2"), wanted_sample(n), n)), few=True), _cores, "core binary").collect() if n > IN_RANGE else []
    settled = sorted_spans(texts_of(entries.filter(F.col("kinds") <= large)), [bytes(r[0]) for r in sample], n - n_big)
    if n_big:
        in_large = entries.filter(F.col("kinds") > large)
        settled = settled.unionByName(counted_spans(texts_of(in_large), in_large, large))
    by_class = cut(settled)
    spans = members.join(by_class, ["c1", "c2"]).select("k1", "k2", (F.col("pos") - F.col("before")).alias("from"), (F.col("pos") + F.col("after")).alias("to"))
    return held.select("doc_id", "k1", "k2", "text"), spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """data without the merged spans."""
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _removed(f: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for d, t, s in zip(f["doc_id"], f["text"], f["spans"], strict=True):
        data = _encoded(t)
        runs = merged([(x["from"], x["to"]) for x in s])
        kept = without(data, runs)
        rows.append((d, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"from": a, "to": b} for a, b in runs]))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (from, to) for each row of docs (doc_id, text).

    Null and short texts have no repeats; of identical rows each is a place of its own, so long
    ones lose all; rows that share an id but not their text are apart; an empty table gives no
    rows. Only texts with spans meet their spans; the digests of the others come from the scan.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(1), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "doc_id").alias("k2"))
    held, spans = repeated_spans(keyed.select("doc_id", "k1", "k2", "text"), large)
    listed = cut(spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from", "to")).alias("spans")))
    ids = keyed.select("doc_id", "k1", "k2", F.octet_length("text").alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<from: bigint, to: bigint>>"
    changed = map_batches(held.join(listed, ["k1", "k2"]).select("doc_id", "text", "spans"), _removed, schema)
    same = ids.join(listed.select("k1", "k2"), ["k1", "k2"], "left_anti").select(
        "doc_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<from: bigint, to: bigint>>").alias("spans"),
    )
    return changed.unionByName(same)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    return dedup(read(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")
