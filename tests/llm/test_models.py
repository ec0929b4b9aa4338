"""Language identification, the quality classifier and decontamination: gradients, held-out accuracy, planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontamination, language_id, quality_classifier, vectext
from tests_llm_tools import words_of


@pytest.mark.parametrize("masked", [False, True])
def test_gradient_is_the_slope(masked):
    m = language_id.new_model(3, 1)
    r = np.random.default_rng(1)
    x, y = r.integers(0, 256, (12, 5)), np.array([0, 1, 2, 0, 1])
    valid = np.arange(12)[:, None] < np.array([12, 7, 1, 0, 12]) if masked else None
    _, g = language_id.loss_and_gradient(m, x, y, valid)
    for k, v in m.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        e = 1e-6
        v[at] += e
        up = language_id.loss_and_gradient(m, x, y, valid)[0]
        v[at] -= 2 * e
        down = language_id.loss_and_gradient(m, x, y, valid)[0]
        v[at] += e
        assert abs(g[k][at] - (up - down) / 2 / e) < 1e-6


def test_reader_agrees_with_the_network_trained():
    m = language_id.new_model(3, 2)
    data = bytes(range(256)) * 2
    rows, valid = language_id.stretches_of(data)
    fs, _ = language_id._forward(m, language_id.LEFT, rows.T[: language_id.CONTEXT + language_id.LENGTH])
    bs, _ = language_id._forward(m, language_id.RIGHT, rows.T[::-1][: language_id.CONTEXT + language_id.LENGTH])
    both = np.concatenate([fs[language_id.CONTEXT :], bs[language_id.CONTEXT :][::-1]], axis=2)
    want = (np.log(language_id._softmax(both @ m["o"] + m["c"])) * valid.T[:, :, None]).sum(axis=(0, 1))
    text = data.decode("latin-1")
    assert np.allclose(language_id.Reader(m).log_probabilities(rows, valid).sum(axis=0), want, atol=1e-2)
    assert language_id.label([None, "", text], language_id.Reader(m)).shape == (3, 3)


def test_language_id(spark, odd, empty):
    r = random.Random(4)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(1000 + i, make("abcde" if i % 2 else "vwxyzü", 30), "aa" if i % 2 else "zz") for i in range(300)]
    docs = spark.createDataFrame([*rows, (1, None, "aa"), (2, "", "aa"), (3, "12 34 !!", "zz"), (4, make("abcde", 30_000), None)], "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language_id.identify(docs, steps=60).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows) and out[4].lang_pred == "aa"
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= x.score <= 1 for x in out.values())
    assert language_id.identify(docs.filter("doc_id IN (1001, 1, 3)"), steps=1).filter("lang_pred = 'und'").count() == 2
    assert language_id.identify(empty).count() == 0


def test_language_of_short_texts_only(spark):
    r = random.Random(14)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, make("abcde", 60), "aa") for i in range(150)] + [(1000 + i, make("vwxyz", 4), "zz") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x.lang_pred for x in language_id.identify(docs, steps=80).collect()}
    assert np.mean([out[i] == lang for i, _, lang in rows]) > 0.98


def test_sample_takes_from_all_of_a_text(spark):
    tail = spark.createDataFrame([(2 * i, "a" * 50_000 + "b" * 50_000, lang) for i, lang in enumerate(["x", "y"] * 10)], "doc_id long, text string, lang string")
    sample = language_id.learning_sample(tail, 400)
    late = sum(b"b" in data for data, _ in sample)
    assert 200 < len(sample) <= 800 and 0.35 < late / len(sample) < 0.65


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(60, numPartitions=1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = vectext.map_batches(docs, lambda f: f.assign(n=len(f))[["id", "n"]], "id long, n long").agg(F.max("n"), F.count("*")).first()
    assert sizes[0] <= vectext.BYTES / (1 << 20) + 1 and sizes[1] == 60


def test_quality_classifier(spark, odd, empty):
    r = random.Random(5)
    rows = [(1000 + i, " ".join(w + "***" * (i % 4 == 0) for w in words_of(r, 60)), int(i % 4 != 0)) for i in range(400)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, y int").unionByName(spark.createDataFrame([(1000 + 4 * i, 0) for i in range(50)] + [(1, None)], "doc_id long, y int"))
    out = {x.doc_id: x for x in quality_classifier.score(docs, labels).collect()}
    assert np.mean([out[i].predicted == q for i, _, q in rows]) > 0.97
    assert all(0 <= x.score <= 1 for x in out.values()) and {4, 5, 6} <= set(out)
    none = quality_classifier.score(docs, labels.limit(0))
    assert {x.score for x in none.collect()} == {0.5} and quality_classifier.score(empty, labels).count() == 0
    thin = quality_classifier.score(docs, labels, max_rows=100)
    assert thin.count() == docs.count()


def test_normal_equations_are_the_sums(spark):
    r = np.random.default_rng(6)
    k = len(quality_classifier.NAMES)
    x, y = r.normal(size=(50, k)), r.integers(0, 2, 50)
    model = {"mean": np.zeros(k), "sd": np.ones(k), "w": r.normal(size=(k, quality_classifier.FEATURES)), "b": r.uniform(size=quality_classifier.FEATURES)}
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y int").repartition(3)
    a = np.hstack([quality_classifier.fourier(x, model), y[:, None]])
    want = a.T @ a
    assert all(abs(want[i, j] - v) < 1e-9 for i, j, v in quality_classifier._sums(df, model).collect())


def test_pool_adjacent_violators():
    assert quality_classifier.pool_adjacent([(0.0, 1, 2), (0.5, 0, 2), (1.0, 2, 2)]) == ([0.25, 1.0], [0.25, 1.0])


def test_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    r = random.Random(7)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 70))] for _ in range(2))
        assert decontamination.lcs(a, b) == slow(a, b)


@pytest.fixture(scope="module")
def planted(spark, odd):
    r = random.Random(8)
    items = [(i, ". ".join(" ".join(words_of(r, 8)) for _ in range(4)) + ".") for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        body = words_of(r, 150)
        if d % 3 == 0:
            i = d % 12
            given = items[i][1].split()
            if d % 2:
                given = [w if k % 8 else "other" for k, w in enumerate(given)]
            at = r.randint(0, 150)
            body[at:at] = [w.upper() if d % 5 == 0 else w for w in given]
            want.add((1000 + d, i))
        docs.append((1000 + d, " ".join(body)))
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, " ")], "item_id long, text string")
    return df, bench, want


def test_decontamination(planted, empty):
    docs, bench, want = planted
    out = decontamination.leaks(docs, bench, rank=48).collect()
    got = {(x.doc_id, x.item_id) for x in out}
    assert len(got) == len(out) and got <= want and len(got) >= 0.95 * len(want)
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0 and decontamination.leaks(empty, bench).count() == 0


def everywhere(docs, items):
    """The pairs that the rule finds at any place of any document, without a search."""
    out = set()
    for d, text in docs:
        words = decontamination.plain((text or "").split())
        for i, t in items:
            item, answer = decontamination.plain((t or "").split()), decontamination.answer_of(t or "")
            for s in range(0, len(words) if item else 0, decontamination.STRIDE):
                near = words[max(0, s - len(item)) : s + decontamination.WINDOW + len(item)]
                share = decontamination.lcs(item, near) / len(item)
                if share >= decontamination.SURE or (share >= decontamination.LIKELY and decontamination.lcs(answer, near) >= decontamination.ANSWER * len(answer)):
                    out.add((d, i))
                    break
    return out


def test_recall_against_search_everywhere(spark, monkeypatch):
    """Verbatim copies and paraphrases, items with common words, documents that only share those; production rank."""
    r = random.Random(12)
    common = words_of(r, 40)
    text = lambda n: [r.choice(common) if r.random() < 0.5 else words_of(r, 1)[0] for _ in range(n)]
    items = [(i, ". ".join(" ".join(text(r.randint(6, 12))) for _ in range(r.randint(2, 5))) + ".") for i in range(60)]
    items += [(60, " ".join(r.choice(common) for _ in range(20)) + ".")]
    docs = []
    for d in range(240):
        body = text(r.randint(30, 200))
        if d % 2 == 0:
            given = [w if r.random() > (d % 5) * 0.08 else words_of(r, 1)[0] for w in items[d % 61][1].split()]
            at = r.randint(0, len(body))
            body[at:at] = given
        docs.append((d, " ".join(body)))
    want = everywhere(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(df, bench).collect()}
    assert len(want) > 90 and got <= want and len(got) >= 0.97 * len(want)
    # without the gate on shared words: it loses next to nothing
    monkeypatch.setattr(decontamination, "SHARED", 0.0)
    table = decontamination.fit(df, bench)
    f = decontamination.searcher(items, table, decontamination.COSINE, decontamination.SURE, decontamination.LIKELY)(df.toPandas())
    ungated = set(zip(f["doc_id"], f["item_id"], strict=True))
    assert got <= ungated <= want and len(ungated - got) <= 0.01 * len(want)


def test_items_in_several_passes(planted, monkeypatch):
    docs, bench, want = planted
    monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", 5)
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench, rank=48).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_document_frequencies_cover_all_documents(planted):
    docs, _, _ = planted
    df, n = decontamination.document_frequencies(docs)
    assert n == docs.count()
    total = sum(len({int(b) for b in decontamination.buckets(w)}) for w in decontamination.word_hashes([r.text for r in docs.collect()]))
    assert df.sum() == total


def test_fold_matches_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", quality_classifier.fold(F.col("id"), 4)).collect()
    assert all(v == zlib.crc32(str(i).encode()) % 4 for i, v in rows)
