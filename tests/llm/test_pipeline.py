"""The pipeline's stages on planted cases, against brute force."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_duplicates import near_group, shingles
from tests_llm_tools import words_of
from textloom.llm import decontamination


def groups(texts, percent=80):
    """For each text the least place of its group; texts without words are groups of their own."""
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    links = [(a, b) for b, y in enumerate(sets) for a, x in enumerate(sets[:b]) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def similarity(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_duplicates_from_80_percent(spark):
    r = random.Random(21)
    texts = []
    for k in range(60):
        a = words_of(r, 150)
        b = list(a)
        # three or four words apart: 15 or 20 of 146 shingles, 0.81 or 0.76
        for at in (20, 60, 100, 140)[: 3 + k % 2]:
            b[at] = "changed"
        texts += [" ".join(a), " ".join(b)]
    texts += [*near_group(r, 10, 1), *(" ".join(words_of(r, 40)) for _ in range(10))]
    between = sum(0.8 <= similarity(texts[i], texts[i + 1]) < 0.85 for i in range(0, 120, 2))
    assert between == 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(set(groups(texts)))


SCHEMA = "doc_id long, text string, source string"


def test_near_duplicates_of_null_and_repeated_ids(spark):
    r = random.Random(22)
    base, other, third = (" ".join(words_of(r, 80)) for _ in range(3))
    near = base.replace(base.split()[40], "changed", 1)
    rows = [
        (None, base, "a"), (7, near, "a"), (5, base, "b"), (5, base, "a"),  # one group: id 5 stays, once
        (None, other, "a"), (None, other, "b"), (None, other, "b"),  # one group without an id
        (3, third, "a"), (3, " ".join(words_of(r, 80)), "a"), (3, " ".join(words_of(r, 80)), "a"),  # one id, texts apart
        (8, "", "a"), (9, "", "a"), (9, "", "a"), (10, None, "a"), (None, " \n", "a"), (None, None, "a"),
    ]
    rows += [(None, " ".join(words_of(r, 60)), "c") for _ in range(20)]
    texts = [t for _, t, _ in rows]
    label = groups(texts)
    want = set()
    for g in set(label):
        here = [x[:2] for x, k in zip(rows, label, strict=True) if k == g]
        want.add(min(here, key=lambda x: (x[0] is None, x[0] or 0)))
    docs = spark.createDataFrame(rows, SCHEMA)
    out = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(out) == len(want) and {x[:2] for x in out} == want
    again = [tuple(x) for x in corpus_pipeline.near_duplicates(spark, docs.orderBy(F.desc("source"), "text").repartition(3), "").collect()]
    assert sorted(out, key=repr) == sorted(again, key=repr)


def test_benchmark_by_row(spark, tmp_path):
    r = random.Random(23)
    items = [(i, ". ".join(" ".join(words_of(r, 8)) for _ in range(4)) + ".") for i in range(4)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, " ".join(words_of(r, 150)), "a") for i in [None] * 10 + [5, 6, 6]]
    bad = [(i, " ".join([*words_of(r, 60), items[k % 4][1], *words_of(r, 60)]), "a") for k, i in enumerate([None, None, 5, 7])]
    out = corpus_pipeline.benchmark(spark, spark.createDataFrame([*clean, *bad], SCHEMA), str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(clean, key=repr)


def test_quality_by_row(spark, tmp_path):
    r = random.Random(24)
    make = lambda good: " ".join(w + "***" * (not good) for w in words_of(r, 60))
    learnt = [(i, make(i % 2), "a") for i in range(300)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(i, make(good), str(good)) for i in (None, 500) for good in (0, 1) for _ in range(5)]
    out = corpus_pipeline.quality(spark, spark.createDataFrame([*learnt, *rows], SCHEMA), str(tmp_path))
    assert sorted(map(tuple, out.filter("source <> 'a'").collect()), key=repr) == sorted((x for x in rows if x[2] == "1"), key=repr)


CLASH = ("n_removed", "_text", "_row", "_all", "_own_n_lines", "_plan", "weight", "component_id", "k", "keys", "h1", "est")


@pytest.fixture(scope="module")
def clashing(odd):
    """Odd rows whose extra columns have names that the stages use themselves."""
    return odd.withColumns({c: F.lit(c) for c in CLASH}).cache()


def rows_of(df):
    return Counter(repr(x) for x in df.collect())


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, data, clashing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, clashing.limit(0), data).count() == 0
    out = stage(spark, clashing, data)
    got = out.collect()
    more = ["size", "source_size", "target", "repeats", "taken"] if name == "mixing" else []
    assert out.columns == clashing.columns + more
    before = clashing.count()
    assert len(got) <= before and all(tuple(x[c] for c in CLASH) == CLASH and x.score == "x" and x.id == 8 and x.n_lines == 7 for x in got)
    if name == "mixing":
        assert rows_of(out.select(*clashing.columns)) == rows_of(clashing)
    elif name == "line_dedup":  # no line is on ten sites; what has no word in the first place stays
        assert rows_of(out) == rows_of(clashing)
    elif name == "benchmark_decontamination":
        assert rows_of(out) == rows_of(clashing)
    elif name == "minhash_near_dedup":
        texts = [x.text for x in clashing.collect()]
        assert len(got) == len(set(zip([x.doc_id for x in clashing.collect() if not shingles(x.text)], ["bare"] * 99))) + len({k for k, t in zip(groups(texts), texts, strict=True) if shingles(t)})
    else:
        assert rows_of(out) - rows_of(clashing) == Counter()


def test_place_that_meets_the_rule_comes_first():
    r = np.random.default_rng(25)
    table = np.vstack([np.hstack([r.normal(0, 0.125, (decontamination.BUCKETS, 64)), np.ones((decontamination.BUCKETS, 1))]), np.zeros((1, 65))]).astype(np.float32)
    body, answer = [f"body{i}" for i in range(34)], [f"answer{i}" for i in range(6)]
    fill = [f"fill{i}" for i in range(300)]
    # 30 of 40 words without the answer, and 26 with it
    doc = " ".join([*fill[:100], *body[:30], *fill[100:200], *body[14:], *answer, *fill[200:]])
    item = " ".join(body) + ". " + " ".join(answer) + "."
    got = decontamination.searcher([(1, item)], table, 0.3, 0.8, 0.6)(pd.DataFrame({"doc_id": [7], "text": [doc]}))
    assert got[["doc_id", "item_id", "lcs"]].values.tolist() == [[7, 1, 0.65]]
