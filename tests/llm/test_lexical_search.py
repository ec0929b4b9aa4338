"""Ranked search against scores taken term by term, bounds against scores, odd rows, small blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from textloom.llm import lexical_search as ls

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, missing, i) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if missing else i, -s] += 1
    return out


def found(spark, docs, items, k=10):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    return Counter(tuple(r) for r in ls.search(ls.build(d), spark.createDataFrame(items, "item_id long, text string"), k).collect())


@pytest.fixture(scope="module")
def zipf():
    r = random.Random(5)
    names = ["é%d" % i if i % 7 == 0 else "W%dx" % i for i in range(400)]
    text = lambda n: " ,".join(names[min(399, int(r.paretovariate(0.7)) - 1)] for _ in range(n))
    docs = [(i, text(r.randint(1, 60))) for i in range(300)]
    docs += [(2**60 + 1, docs[3][1]), (None, docs[3][1]), (-7, docs[3][1]), (None, None), (400, ""), (401, " ., \n"), (402, text(5000)), (403, docs[5][1].upper()), (403, docs[5][1]), (404, "\x00A B\U0001F600")]
    items = [(j, text(r.randint(1, 30))) for j in range(40)] + [(0, docs[3][1]), (0, docs[3][1]), (0, "other é7"), (None, docs[4][1]), (50, None), (51, ""), (52, "nowhere at all"), (53, "a b\U0001F600")]
    return docs, items


def test_against_scores_term_by_term(spark, zipf, monkeypatch):
    docs, items = zipf
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, 3) == plain(docs, items, 3)
    monkeypatch.setattr(ls, "CHUNK", 7)  # the chunks of a task keep scores of their own
    assert found(spark, docs, items) == plain(docs, items)


def test_blocks_and_pieces_dont_change_results(zipf, monkeypatch):
    docs, _ = zipf
    whole = ls.term_counts(docs[-4][1].encode())
    monkeypatch.setattr(ls, "PIECE", 5)
    assert ls.term_counts(docs[-4][1].encode()) == whole == Counter(t.encode() for t in terms_of(docs[-4][1]))


def test_bounds_hold(zipf):
    r = np.random.default_rng(3)
    tf, lengths = r.integers(1, 10**6, 5000).astype(np.int32), r.integers(1, 10**7, 5000)
    u = ls._us(tf, lengths, 10**6, 10**9)
    exact = [10**9 * int(a) // (1000 * int(a) + 8 * (10 + 90 * int(b) * 10**6 // 10**9)) for a, b in zip(tf, lengths, strict=True)]
    impact = (u + ls.STEP - 1) // ls.STEP
    assert u.tolist() == exact and impact.max() <= 255 and u.max() < 10**6
    assert ((impact * ls.STEP >= u) & ((impact - 1) * ls.STEP < u) | (u == 0)).all()


def test_only_documents_whose_bound_reaches_are_scored(monkeypatch):
    """In one block: few of many documents are scored exactly, and what is left out scores less."""
    r = random.Random(9)
    block = ls._Block()
    texts = [" ".join(f"t{min(99, int(r.paretovariate(0.6)) - 1)}" for _ in range(r.randint(3, 90))) for _ in range(2000)]
    for i, t in enumerate(texts):
        block.add(i, ls.term_counts(t.encode()))
    row = block.row().to_pylist()[0]
    lengths, doc, tf = (np.frombuffer(row[c], t) for c, t in (("lengths", np.int64), ("doc", np.uint16), ("tf", np.int32)))
    row["impact"] = ((ls._us(tf, lengths[doc], row["n_docs"], row["n_terms"]) + ls.STEP - 1) // ls.STEP).astype(np.uint8).tobytes()
    chunk = [{"item": 1, "term": f"t{j}", "w": 1000 + 40 * j} for j in (0, 3, 20, 50, 77)]
    items = ls._Items(chunk, 10)
    [(_, may, score)] = list(ls._in_block(row, items, 10, row["n_docs"], row["n_terms"]))
    want = []
    for t in texts:
        c = ls.term_counts(t.encode())
        n = sum(c.values())
        m = 10 + 90 * n * row["n_docs"] // row["n_terms"]
        want.append(sum(x["w"] * (10**9 * c[k] // (1000 * c[k] + 8 * m)) for x in chunk if (k := x["term"].encode()) in c))
    assert dict(zip(may.tolist(), score.tolist(), strict=True)) == {i: want[i] for i in may.tolist()}
    assert sorted(want)[-10:] == sorted(score.tolist())[-10:] and len(may) < 100
    again = list(ls._in_block(row, items, 10, row["n_docs"], row["n_terms"]))  # the task knows its best now
    assert len(again[0][1]) <= 10 + sum(s == sorted(want)[-10] for s in want)


def test_odd_tables(spark, odd, odd_rows, empty):
    docs = [(r[0], r[1]) for r in [*odd_rows, odd_rows[0]]]
    items = [(1, odd_rows[0][1][:300]), (2, "shared LINE"), (3, "x q"), (4, odd_rows[7][1][:2000])]
    given = spark.createDataFrame([(*x, 1, 2, "s") for x in items], "item_id long, text string, rank int, item int, term string")
    got = Counter(tuple(r) for r in ls.search(ls.build(odd), given).collect())
    assert got == plain(docs, items)
    assert ls.search(ls.build(empty), given).count() == 0 and ls.search(ls.build(odd), given.limit(0)).count() == 0
    assert ls.search(ls.build(odd), given).columns == ["item_id", "rank", "doc_id", "score"]
