"""MinHash, components and suffix dedup against brute force, and the pipeline's stages."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import components, minhash, suffix_dedup, vectext
from tests_llm_tools import words_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall((t or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, percent=85):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, b in enumerate(ids) for a in ids[:k] if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def near_group(r, n, edits):
    base = words_of(r, 150)
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(150), edits):
            w[k] = "".join(r.choice("klmno") for _ in range(5))
        yield " ".join(w)


def test_minhash(spark, odd, empty):
    r = random.Random(9)
    rows = [(1000 + i, t) for i, t in enumerate([*near_group(r, 12, 2), *near_group(r, 12, 4), *near_group(r, 10, 9), *(" ".join(words_of(r, 40)) for _ in range(10))])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    every = [(x.doc_id, x.text) for x in docs.collect()]
    want = brute_components(every)
    out = minhash.components(docs).collect()
    assert sorted((x.doc_id, x.n_shingles) for x in out) == sorted((i, len(shingles(t))) for i, t in every)
    assert all(x.component_id == want[x.doc_id] and x.kept == (x.doc_id == want[x.doc_id]) for x in out)
    assert minhash.components(empty).count() == 0


def test_minhash_of_null_and_shared_ids(spark):
    """Rows without an id link like others; an id's texts link one by one, whatever else the id has."""
    r = random.Random(31)
    base, other, far, long = (" ".join(words_of(r, n)) for n in (100, 120, 90, 3000))
    near = lambda t, k: t.replace(t.split()[k], f"changed{k}", 1)
    rows = [
        (50, base), (None, near(base, 60)), (None, near(base, 60)), (None, near(base, 60)),  # without an id, near one that has one, repeated
        (None, other), (None, near(other, 50)), (None, other),  # no row has an id
        (7, far), (7, long), (8, near(far, 40)), (9, near(long, 500)), (9, "word"), (None, "word"),  # ids of texts apart
        (7, ""), (None, ""), (None, None), (3, None), (60, base), (60, base),
    ]
    rows += [(None, " ".join(words_of(r, 30))) for _ in range(5)]
    # brute force: rows without an id get ids of their own, beyond all others
    mine = [(i if i is not None else 1000 + n, t) for n, (i, t) in enumerate(rows)]
    own = brute_components([(i, t) for i, t in mine if shingles(t)])
    want = []
    for (i, t), (j, _) in zip(rows, mine, strict=True):
        top = own[j] if shingles(t) else i
        top = None if top is not None and top >= 1000 else top
        want.append((i, len(shingles(t)), top, i == top))
    out = minhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert Counter(tuple(x) for x in out.collect()) == Counter(want)
    assert sum(w[2] == 50 for w in want) == 6 and sum(w[2] == 7 for w in want) == 7


def test_bitmaps_never_rule_out_what_sets_share(spark):
    r = random.Random(4)
    texts = [*near_group(r, 15, 6), *near_group(r, 15, 20), " ".join(words_of(r, 9000)), " ".join(words_of(r, 3)), "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = vectext.map_batches(docs, minhash.signatures(8, 3, 1, 85), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, bits array<long>")
    x, y = (signed.select(F.col("doc_id").alias(e), F.col("n_shingles").alias(f"{e}n"), F.col("bits").alias(f"{e}bits")) for e in "ab")
    sets = [shingles(t) for t in texts]
    got = [(p.a, p.b, p.m) for p in x.join(y, F.col("a") < F.col("b")).select("a", "b", minhash.possible("a", "b").alias("m")).collect()]
    assert len(got) == len(texts) * (len(texts) - 1) // 2
    assert all(m >= len(sets[a] & sets[b]) for a, b, m in got)
    group = [(m, len(sets[a] & sets[b])) for a, b, m in got if 15 <= a < b < 30]
    assert all(100 * m < 85 * (len(sets[20]) * 2 - m) for m, _ in group)


def test_words_are_those_of_the_pattern():
    texts = [None, "", "a\x0bB\x0cc d\u0085e\x1cf", "Ünï CODE " * 3, "x" * (vectext.PIECE + 10) + " y", "ab " * 100_000]
    seen = {}
    for t, h in zip(texts, vectext.word_hashes(texts), strict=True):
        w = WORD.findall((t or "").translate(LOW))
        assert len(w) == len(h)
        for a, b in zip(w, h.tolist(), strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    r = random.Random(10)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in label.items() if k in got} and all(k in got or label[k] == k for k in label)


def brute_removed(texts):
    size = suffix_dedup.SIZE
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + size] for d in data for p in range(len(d) - size + 1))
    out = []
    for d in data:
        spans = suffix_dedup.merged([(p, p + size) for p in range(len(d) - size + 1) if n[d[p : p + size]] > 1])
        kept = suffix_dedup.without(d, spans)
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def repeats():
    r = random.Random(11)
    passage, long = " ".join(words_of(r, 75)), " ".join(words_of(r, 400))
    texts = [None, "", "short", "ü" * 700, "a" * 1000, passage, passage[:400], passage[:399], long, long, long[:1500] + "X" + long[1501:], long[300:900] + "Y" + long[300:900]]
    texts += [" ".join(words_of(r, 30)) + passage[k : k + 420] + " ".join(words_of(r, 30)) for k in range(0, 60, 5)]
    texts += [long[: 100 * k] + str(k) + long[100 * k :] for k in range(1, 20)]
    return texts


@pytest.mark.parametrize("pairwise, large, in_range", [(40, 20_000, 20_000), (0, 20_000, 10), (40, 2, 20_000)])
def test_suffix_dedup(spark, repeats, monkeypatch, pairwise, large, in_range):
    monkeypatch.setattr(suffix_dedup, "PAIRWISE", pairwise)
    monkeypatch.setattr(suffix_dedup, "IN_RANGE", in_range)
    docs = spark.createDataFrame(list(enumerate(repeats)), "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(docs, large).collect()}
    assert [got[i] for i in range(len(repeats))] == brute_removed(repeats)


def test_suffix_dedup_odd_tables(spark, odd, empty):
    rows = odd.select("doc_id", "text").collect()
    got = Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.dedup(odd).collect())
    assert got == Counter((r.doc_id, *b) for r, b in zip(rows, brute_removed([r.text for r in rows]), strict=True))
    assert suffix_dedup.dedup(empty).count() == 0


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(12)
    entries = [(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))), b"l", i, -i, 1, 1, 9) for i in range(300)]
    for parts in (1, 2, 5, 8):
        runs = [sorted(entries[i::parts]) for i in range(parts)]
        coded = [suffix_dedup.front_code(run) for run in runs]
        assert [[e for _, e in suffix_dedup.front_decode(c)] for c in coded] == runs
        merged = list(suffix_dedup.LoserTree([suffix_dedup.front_decode(c) for c in coded]))
        assert sorted(e for _, e in merged) == sorted(entries)
        rights = [e[0] for _, e in merged]
        assert rights == sorted(rights)
        assert [k for k, _ in merged[1:]] == [suffix_dedup.common(a, b) for a, b in zip(rights, rights[1:], strict=False)]


def test_pipeline_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).cache()
        before, after = docs.count(), out.count()
        assert 0 < after <= before, name
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "minhash_near_dedup":
            label = brute_components([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.NEAR_PERCENT)
            assert {r.doc_id for r in out.collect()} == set(label.values())
        docs = out.select(*docs.columns)
    total, taken = out.agg(F.sum("size")).first()[0], out.agg(F.sum("taken")).first()[0]
    assert abs(total - taken) <= 20


def test_sample_for_splitters_is_never_empty_and_grows_with_the_ranges(spark):
    """A share below one millionth still chooses rows, about as many as wanted; ranges cut at the sample's quantiles stay even."""
    n = 10**12
    assert suffix_dedup.wanted_sample(10**6) == suffix_dedup.SAMPLE and suffix_dedup.wanted_sample(n) == 8 * n // suffix_dedup.IN_RANGE
    rows = spark.range(3_000_000).select(F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(7)).alias("core"))  # what is sorted by isn't what is chosen by
    for wanted, of in ((4000, 3_000_000), (1, 6_000), (10**4, 10**11)):
        got = rows.filter(suffix_dedup.chosen(F.col("h"), wanted, of)).count()
        want = 3_000_000 * wanted / of
        assert abs(got - want) <= 5 * want**0.5 + 2
    assert rows.filter(suffix_dedup.chosen(F.col("h"), 5, 3)).count() == 3_000_000
    sample = sorted(r.core for r in rows.filter(suffix_dedup.chosen(F.col("h"), 8 * 150, 3_000_000)).collect())
    cuts = sorted({sample[i * len(sample) // 150] for i in range(1, 150)})
    sizes = rows.groupBy(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("core")))).count()
    assert sizes.agg(F.max("count")).first()[0] < 4 * 20_000
