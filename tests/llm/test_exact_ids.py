"""Ids beyond 2**53, negative ones and nulls in one batch come out of every operator as they went in."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import decontamination, language_id, minhash, quality_classifier, suffix_dedup
from tests_llm_tools import words_of

IDS = [2**60 + 1, None, -(2**62) - 3, 2**63 - 1, 7, None, -(2**63)]


@pytest.fixture(scope="module")
def docs(spark):
    import random

    r = random.Random(8)
    base = words_of(r, 160)
    rows = [(i, " ".join(words_of(r, 90)), "en" if n % 2 else "de") for n, i in enumerate(IDS)]
    rows += [(2**61 + 5, " ".join(base), "en"), (2**61 + 7, " ".join([*base[:-1], "changed"]), "de")]  # near copies
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).cache()


def ids(df, column="doc_id"):
    return Counter(r[0] for r in df.select(column).collect())


def test_ids_are_exact(spark, docs):
    want = ids(docs)
    assert sum(want.values()) == 9 and want[None] == 2
    assert ids(language_id.identify(docs, steps=2)) == want
    assert ids(suffix_dedup.dedup(docs)) == want
    changed = suffix_dedup.dedup(docs).filter("n_removed > 0")
    assert ids(changed) == {2**61 + 5: 1, 2**61 + 7: 1}
    labels = docs.filter("doc_id IS NOT NULL").select("doc_id", (F.col("lang") == "en").cast("int").alias("y"))
    assert ids(quality_classifier.score(docs, labels)) == want
    out = minhash.components(docs)
    assert ids(out) == want
    assert {(r.doc_id, r.component_id) for r in out.filter("doc_id IS NOT NULL").collect()} == {(i, 2**61 + 5 if i == 2**61 + 7 else i) for i in want if i is not None}
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    got = decontamination.leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} >= {(i, i) for i in want} and {r.item_id for r in got.collect()} == set(want)
