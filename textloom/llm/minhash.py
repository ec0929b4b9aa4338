r"""MinHash near-dedup with tensored banding, every link confirmed on the full shingle sets.

COLLECTIONS left and as many right collections of HALF minhashes each are computed; table
(i, j) is keyed by left collection i with right collection j. So COLLECTIONS ** 2 tables of
2 * HALF hashes each cost 2 * COLLECTIONS * HALF minhashes, about the square root of what
tables of their own would. At the least similarity that counts, 0.85, a pair meets in some
table with probability (1 - (1 - 0.85 ** 3) ** 8) ** 2 = 0.999.

1. Documents with one shingle set are a class, found by a 128-bit set hash and numbered; ids of documents,
   which may be null or shared, come in only when the components are named.
2. Collections that no other class shares can't make a table key that another class has, so only
   shared ones are combined into keys.
3. In each table every class meets the least of its bucket: a star, not all pairs. First it is
   confirmed against the least of all these, then against those that this hasn't connected it to.
4. Only buckets that still hold several components get the pairs across them, which makes the links
   whole: every pair that shares a bucket is confirmed, already connected, or ruled out because
   the items that the two sets share with any other set there are too few, or because bitmaps of
   the sets show that too many items of one aren't in the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, small
from textloom.llm.components import connected_components
from textloom.llm.vectext import map_batches, mix, windows, word_hashes

COLLECTIONS, HALF = 8, 3
PERCENT = 85
SEED = 11
CHUNK = 4096
#: 64-bit words of a set's bitmap. A bit that one set has and the other lacks is an item not in common, so the bound is never too low.
BITMAP = 16


def _family(collections: int, half: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    n = 2 * collections * half
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signatures(collections: int, half: int, seed: int, percent: int):
    factors, masks = _family(collections, half, seed)
    nothing = np.zeros(BITMAP, np.int64)

    def bitmap(m: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * BITMAP, np.uint8)
        bits[mix(m + np.uint64(2)) % np.uint64(64 * BITMAP)] = 1
        return np.packbits(bits).view(np.int64)

    def fn(frame: pd.DataFrame) -> pd.DataFrame:
        rows, carried = [], frame.drop(columns="text")
        for words in word_hashes(list(frame["text"])):
            s = np.unique(windows(words))
            if not len(s):
                rows.append((0, 0, 0, [], nothing))
                continue
            least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(s), CHUNK):
                np.minimum(least, ((s[at : at + CHUNK, None] ^ masks) * factors).min(axis=0), out=least)
            groups = least.reshape(2 * collections, half)
            keys = np.zeros(2 * collections, np.uint64)
            for j in range(half):
                keys = mix(keys + groups[:, j])
            m = mix(s)
            rows.append((len(s), m.sum(dtype=np.uint64).astype(np.int64), np.bitwise_xor.reduce(mix(m + np.uint64(1))).astype(np.int64), keys.view(np.int64), bitmap(m)))
        made = pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "keys", "bits"], index=carried.index)
        return pd.concat([carried, made], axis=1)

    return fn


def _sets(frame: pd.DataFrame) -> pd.DataFrame:
    rows = [(i, np.unique(windows(w)).view(np.int64)) for i, w in zip(frame["id"], word_hashes(list(frame["text"])), strict=True)]
    return pd.DataFrame(rows, columns=["id", "items"])


def bucket_rows(classes: DataFrame, collections: int) -> DataFrame:
    """(key, id, n, i, j): a row for each table (i, j) in which both collections of a class are shared with others."""
    parts = classes.select("id", "n", F.posexplode("keys").alias("c", "v"))
    shared = parts.groupBy("c", "v").agg(F.count("*").alias("k")).filter("k > 1").select("c", "v")
    mine = parts.join(shared, ["c", "v"]).groupBy("id", "n").agg(F.collect_list(F.struct("c", "v")).alias("s"))
    left, right = (F.filter("s", lambda x: x["c"] < collections), F.filter("s", lambda x: x["c"] >= collections))
    pairs = mine.select("id", "n", F.explode(left).alias("l"), right.alias("r")).select("id", "n", "l", F.explode("r").alias("r"))
    return pairs.select(F.xxhash64("l.c", "l.v", "r.c", "r.v").alias("key"), "id", "n", F.col("l.c").alias("i"), F.col("r.c").alias("j"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough. One set a pair is carried, the other joined to it."""
    sa = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    sb = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    j = pairs.join(sb, "b").join(sa, "a")
    common = F.size(F.array_intersect("x", "y"))
    return j.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def shared_counts(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (key, id, n, ...) with m: how many of a set's items occur in another set of rows too.

    What only one set has can be in no intersection, so m bounds them all: of copies that each
    have edits of their own, most pairs are ruled out before a set is carried.
    """
    here = sets.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.explode("items").alias("item"))
    alone = here.groupBy("item").agg(F.count("*").alias("k"), F.min("id").alias("id")).filter("k = 1").groupBy("id").agg(F.count("*").alias("u"))
    return rows.join(alone, "id", "left").withColumn("m", F.col("n") - F.coalesce("u", F.lit(0))).drop("u")


def first_table(collections: int):
    """Whether (i, j) is the first table of the pair, so that one met in many tables comes out of one."""
    same = F.zip_with("akeys", "bkeys", lambda x, y: x == y)
    right = F.slice(same, collections + 1, collections)
    return (F.array_position(same, True) == F.col("i") + 1) & (F.array_position(right, True) == F.col("j") - collections + 1)


def possible(x: str, y: str):
    """How many items sets x and y can have in common: columns xn and xbits, yn and ybits."""
    lacks = lambda a, b: sum(F.bit_count(F.col(f"{a}bits")[i].bitwiseAND(F.bitwise_not(F.col(f"{b}bits")[i]))) for i in range(BITMAP))
    return F.least(F.col(f"{x}n") - lacks(x, y), F.col(f"{y}n") - lacks(y, x))


def one_text_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of wanted classes (id, doc_id, t1, t2: a row that has the set), once each however often that row is repeated."""
    w = wanted.select("id", *[F.col(c).alias("w_" + c) for c in ("doc_id", "t1", "t2")])
    same = (F.col("t1") == F.col("w_t1")) & (F.col("t2") == F.col("w_t2")) & F.col("doc_id").eqNullSafe(F.col("w_doc_id"))
    return docs.join(w, same).groupBy("id").agg(F.first("text").alias("text"))


def of_one_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of an id's texts, where rows that share an id have different sets."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("s1", "s2") for f in (F.min, F.max)]
    several = full.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*ends).filter("min_s1 < max_s1 OR min_s2 < max_s2").select("doc_id")
    shared = full.select("doc_id", "s1", "s2").join(small(cut(several)), "doc_id").distinct()
    mine = cut(shared.join(classes.select("s1", "s2", "id"), ["s1", "s2"]).select("doc_id", "id"))
    least = mine.groupBy("doc_id").agg(F.min("id").alias("a"))
    return cut(mine.join(least, "doc_id").filter("a <> id").select("a", F.col("id").alias("b")))


def _ratio(percent: int, x: str, y: str):
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def components(docs: DataFrame, percent: int = PERCENT, collections: int = COLLECTIONS, half: int = HALF, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs (doc_id bigint, text).

    Null, empty and blank texts have no shingles, link with nothing and are kept; of identical
    rows each is returned, alike; rows that share an id are one document with the links of all
    its texts. Rows without an id are documents of their own, linked like others: a component is
    named by its least id, and where no row has one its component_id is null and all its rows are
    kept. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    signed = cut(map_batches(docs, signatures(collections, half, seed, percent), "doc_id bigint, t1 bigint, t2 bigint, n_shingles bigint, s1 bigint, s2 bigint, keys array<bigint>, bits array<bigint>"))
    full = signed.filter("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2"))
    classes = full.groupBy("s1", "s2").agg(least.alias("of"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))  # fixed from here on, as they are read from what was written
    rows = cut(bucket_rows(classes, collections))
    heads = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("k")).filter("k > 1")
    stars = rows.join(heads.select("key", F.col("h.id").alias("a"), F.col("h.n").alias("an")), "key").filter(F.col("id") != F.col("a"))
    stars = cut(stars.filter(_ratio(percent, "n", "an")).select("a", F.col("id").alias("b")).distinct())
    wanted = small(cut(classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", "of.doc_id", "of.t1", "of.t2")))
    sets = cut(map_batches(one_text_each(docs, wanted), _sets, "id bigint, items array<bigint>", ("id",)))
    # one head a class first: in a group of near copies that connects most, and what is connected needs no other link
    least = cut(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    near = cut(confirm(least, sets, percent))
    up = near.select(F.col("a").alias("b")).distinct().join(near.select("b", F.col("a").alias("top")), "b").select(F.col("b").alias("a"), "top")
    label = cut(near.join(up, "a", "left").select(F.col("b").alias("id"), F.coalesce("top", "a").alias("top")))
    open_ = stars.join(least, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        open_ = open_.join(label.select(F.col("id").alias(end), F.col("top").alias(f"{end}_in")), end, "left").withColumn(f"{end}_in", F.coalesce(f"{end}_in", end))
    links = cut(near.unionByName(confirm(cut(open_.filter("a_in <> b_in").select("a", "b")), sets, percent)))
    first = cut(connected_components(links))
    labelled = rows.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    rest = cut(labelled.join(mixed, "key"))
    rest = cut(shared_counts(rest, sets).filter(100 * F.col("m") >= percent * F.col("n")))
    rest = rest.join(classes.select("id", "keys", "bits"), "id")
    x = rest.select("key", "i", "j", *[F.col(c).alias(f"a{c}") for c in ("id", "n", "m", "component", "keys", "bits")])
    y = rest.select("key", *[F.col(c).alias(f"b{c}") for c in ("id", "n", "m", "component", "keys", "bits")])
    most = F.least("am", "bm")  # that two sets can have in common
    both = F.col("an") + F.col("bn")
    close = (100 * most >= percent * (both - most)) & ((100 + percent) * possible("a", "b") >= percent * both)
    across = x.join(y, "key").filter((F.col("acomponent") != F.col("bcomponent")) & (F.col("aid") < F.col("bid")) & close & first_table(collections))
    across = across.select(F.col("aid").alias("a"), F.col("bid").alias("b"))
    across = across.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    every = links.unionByName(cut(confirm(across, sets, percent))).unionByName(of_one_id(full, classes))
    label = cut(connected_components(every))
    of_class = cut(classes.select("s1", "s2", "id", F.col("of.doc_id").alias("least")).join(label, "id", "left").withColumn("component", F.coalesce("component", "id")))
    names = of_class.groupBy("component").agg(F.min("least").alias("name"))
    named = of_class.join(names, "component").select("s1", "s2", "name")
    out = signed.select("doc_id", "n_shingles", "s1", "s2").join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_minhash(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    return components(read(spark, sf_dir, "documents", "doc_id", "text"))
