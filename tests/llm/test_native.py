"""Line dedup, quality rules, URL filter, mixing and WARC derivatives against brute force and SQL."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from textloom.llm import line_dedup, mixing, quality_rules, queries, url_filter, warc
from tests_llm_tools import collect, words_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    names = sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    fixed = lambda v: round(v, 6) if isinstance(v, float) else v
    count = lambda rs: Counter(repr([fixed(r[c]) for c in names]) for r in rs)
    assert count(r.asDict() for r in entry.queries()[name](spark, data).collect()) == count(rows)


def test_line_dedup(spark, odd, odd_rows, empty):
    rows = [*odd_rows, odd_rows[0]]
    by_text = {r.text: r.h for r in odd.select("text", F.xxhash64("text").alias("h")).collect()}  # of one id the text with the least hash comes first
    for least in (2, 4):
        sites = defaultdict(set)
        first = {}
        for i, t, _, s in rows:
            for p, x in enumerate((t or "").split("\n")):
                if k := x.strip(" \t\r\x0b\x0c"):
                    sites[k].add(s)
                    key = (i, t, p)
                    first[k] = min(first.get(k, key), key, key=lambda a: (a[0], by_text[a[1]], a[2]))
        got = Counter((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(odd, least).collect())
        want = Counter()
        for i, t, _, _ in rows:
            kept = [x for p, x in enumerate((t or "").split("\n")) if not (k := x.strip(" \t\r\x0b\x0c")) or len(sites[k]) < least or (i, t, p) == first[k]]
            want[i, None if t is None else "\n".join(kept), (len((t or "").split("\n")) - len(kept))] += 1
        assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(odd).columns.count("n_lines") == 1
    clash = odd.withColumns({c: F.lit(c) for c in ("_k1", "_k2", "_lines", "_gone", "h1", "h2", "est", "site", "pos", "first")})
    out = line_dedup.dedup_lines(clash, 2)
    assert out.columns == [c for c in clash.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    assert Counter((x.doc_id, x.text, x.n_removed) for x in out.collect()) == Counter((x.doc_id, x.text, x.n_removed) for x in line_dedup.dedup_lines(odd, 2).collect())
    assert {(x._k1, x._gone, x.first) for x in out.collect()} == {("_k1", "_gone", "first")}


def test_line_dedup_near_threshold_is_exact(spark):
    rows = [(s, f"line {n}", f"s{s}") for n in range(8, 13) for s in range(n)]
    docs = spark.createDataFrame([(100 * i + s, t, x) for i, (s, t, x) in enumerate(rows)], "doc_id long, text string, source string")
    left = Counter(t for t in (r.text for r in line_dedup.dedup_lines(docs, 10).collect()) if t)
    assert left == {"line 8": 8, "line 9": 9, "line 10": 1, "line 11": 1, "line 12": 1}


def test_quality_rules(spark, odd, odd_rows, empty):
    r = random.Random(2)
    bad = [(100 + i, " ".join(w + "***" for w in words_of(r, 80)), "en", "z") for i in range(6)] + [(200, "a b c " * 40, "en", "z"), (201, "one line of words\n" * 30, "en", "z")]
    good = [(300 + i, ". ".join(" ".join(words_of(r, 9)) for _ in range(12)), "en", "z") for i in range(40)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([b[:2] for b in bad + good], "doc_id long, text string"))
    w = re.compile(r"[^\x20\x09-\x0D]+")
    got = sorted(tuple(x) for x in quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())
    want = []
    for i, t in [(x[0], x[1]) for x in [*odd_rows, odd_rows[0], *bad, *good]]:
        t = t or ""
        ws = w.findall(t)
        threes = list(zip(ws, ws[1:], ws[2:], strict=False))
        n = Counter(threes)
        marked = {k + d for k, x in enumerate(threes) if n[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if w.search(x)]
        want.append((i, len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked), len(ws) < 50 or 100 * len(marked) > 50 * len(ws)))
    assert got == sorted(want)
    kept = {x.doc_id: x.kept for x in quality_rules.judge(docs).collect()}
    assert all(kept[300 + i] for i in range(40)) and not any(kept[b[0]] for b in bad) and not kept[4]
    assert quality_rules.judge(empty).count() == 0


def cast_votes(r, n, good, accuracy, casting):
    votes = Counter()
    for _ in range(n):
        y = 1 if r.random() < good else -1
        votes[tuple(0 if r.random() > c else (y if r.random() < a else -y) for a, c in zip(accuracy, casting, strict=True))] += 1
    return sorted(votes.items())


@pytest.mark.parametrize("accuracy", [[0.95, 0.9, 0.85, 0.8, 0.9], [0.95, 0.9, 0.9, 0.65, 0.9], [0.9, 0.9, 0.9, 0.85, 0.7]])
def test_em_recovers_planted_accuracies(accuracy):
    model = quality_rules.fit(cast_votes(random.Random(3), 20_000, 0.8, accuracy, [0.9, 0.8, 0.9, 0.7, 0.95]))
    assert abs(model["weights"][0] - 0.8) < 0.05 and abs(sum(model["weights"]) - 1) < 1e-3
    assert all(abs(a - b) < 0.05 for a, b in zip(model["accuracy"], accuracy, strict=True))


def test_em_against_row_by_row():
    """The same estimation with a row for each document and arrays instead of patterns."""
    q = quality_rules
    patterns = cast_votes(random.Random(4), 3000, 0.8, [0.95, 0.9, 0.85], [0.9, 0.8, 0.6])
    model = q.fit(patterns, 7)
    v = np.repeat(np.array([c for c, _ in patterns]), [n for _, n in patterns], axis=0)
    n, m = v.shape
    belief = np.array([[(q.OWN if k == j + 1 else q.BAD if k else q.GOOD)[-1] for j in range(m)] for k in range(m + 1)])
    start = np.array([q.PRIOR] + [(1 - q.PRIOR) / m] * m)
    w, bad = start, belief
    for _ in range(7):
        p = np.stack([w[k] * np.prod(np.where(v < 0, bad[k], np.where(v > 0, 1 - bad[k], 1.0)), axis=1) for k in range(m + 1)])
        p /= p.sum(axis=0)
        w = (p.sum(axis=1) + q.PSEUDO * start) / (n + q.PSEUDO)
        bad = (p @ (v < 0) + q.PSEUDO * belief) / (p @ (v != 0) + q.PSEUDO)
    assert np.allclose(model["weights"], w)
    assert np.allclose([[t[-1] for t in side] for side in model["tables"]], bad)


def test_a_bad_vote_that_no_rule_bears_out_does_not_decide():
    r = random.Random(5)
    votes = Counter()
    for _ in range(20_000):
        bad = r.random() < 0.15
        votes[tuple(-1 if r.random() < (0.85 if bad else 0.02) else 1 for _ in range(3)) + (-1 if r.random() < 0.1 else 1,)] += 1
    model = quality_rules.fit(sorted(votes.items()))
    good = lambda *cast: quality_rules.shares(cast, model["weights"], model["tables"])[0]
    assert good(1, 1, 1, -1) > 0.9 and good(1, 1, 1, 1) > 0.9 and good(1, 0, 1, -1) > 0.5  # all-must-pass rejects the first and last
    assert good(-1, -1, 1, 1) < 0.1 and good(-1, -1, 0, 1) < 0.1


def test_verdicts_follow_the_posterior(spark):
    """Rules that one another bear out reject; long words that only one rule minds don't."""
    r = random.Random(6)
    plain = lambda n, size: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(*size))) for _ in range(n))
    rows = [(i, plain(80, (3, 7))) for i in range(200)] + [(1000 + i, plain(80, (16, 24))) for i in range(6)] + [(2000 + i, plain(80, (3, 7)).replace(" ", "*** ")) for i in range(12)]
    out = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[1000 + i].vote_word_length == -1 and out[1000 + i].kept for i in range(6))
    assert all(out[i].kept for i in range(200)) and not any(out[2000 + i].kept for i in range(12))


URLS = [None, "", "no scheme", "http://A.net", "http://a.net/", "https://example.net/en/x", "http://www.EXAMPLE.net/en/", "http://example.com/de/1", "http://x.example.com/de", "http://fr.org/fr/",
        "http://org/fr/a?b#c", "http://notorg/fr/", "HTTP://Spam.Example.org/a//?utm_source=1&x=2#t", "http://spam.example.org/a?x=2", "a://b://c", "http://spam.example.org"]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate([*URLS, "http://spam.example.org/a?x=2"])], "page_id long, url string, verdict string")
    listed = spark.createDataFrame([("spam.example.org/a?x=2",), ("spam.example.org/a?x=2",), (None,)], "canon string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    rows = [("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "", None, "allow"), ("a.net", "/", "net/", "block"), ("example.net", "/en/x", "example.net/en/", "allow"),
            ("www.example.net", "/en/", "example.net/en/", "allow"), ("example.com", "/de/1", "example.com/de/", "block"), ("x.example.com", "/de", None, "allow"), ("fr.org", "/fr/", "org/fr/", "allow"),
            ("org", "/fr/a", "org/fr/", "allow"), ("notorg", "/fr/", None, "allow"), ("spam.example.org", "/a//", None, "block"), ("spam.example.org", "/a", None, "block"), ("b:", "//c", None, "allow"),
            ("spam.example.org", "", None, "allow"), ("spam.example.org", "/a", None, "block")]
    assert [got[i] for i in range(len(rows))] == rows
    assert url_filter.judge(pages.limit(0), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.limit(0), rules=[]).collect()} == {"allow"}


def test_url_filter_beyond_what_is_broadcast(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h.org/"), F.col("id")).alias("canon"))
    names = "page_id long, url string, _hit string, _says string, _slots int, _block int, _canon int, block int, canon string, w0 int"
    rows = [(i, None if i % 7 == 0 else f"http://h.org/{i % 3000}" if i % 3 else "http://h.org/5", "a", "b", 1, 2, 3, 4, "c", 5) for i in range(4000)]
    rows.append((9999, "http://h.org/" + "x" * 100_000, "a", "b", 1, 2, 3, 4, "c", 5))
    pages = spark.createDataFrame(rows, names)
    want = Counter((i, "block" if u and u.startswith("http://h.org/") and len(u) < 100 and int(u[13:]) < 2000 else "allow", *x) for i, u, *x in rows)
    for most, few in ((1, 10**6), (4, 10**6), (1 << 16, 10**6), (1 << 16, 0), (1, 0)):  # too dense to be used, dense, as wanted; both joins
        out = url_filter.judge(pages, listed, [], max_blocks=most, small_rows=few)
        assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
        assert Counter((r.page_id, r.verdict, *r[2:10]) for r in out.collect()) == want


def test_bloom_filter_acts_before_the_shuffle(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h/"), F.col("id")).alias("canon"))
    urls = spark.range(0, 40_000, 2).select(F.concat(F.lit("h/"), F.col("id")).alias("canon"))
    marked, passed = url_filter.candidates(urls, "canon", listed)
    n = marked.filter(passed).count()
    assert 1000 <= n < 2000 and marked.filter(passed).join(listed, "canon", "left_semi").count() == 1000
    plan = marked.filter(passed).select("canon").distinct().join(listed, "canon")._jdf.queryExecution().executedPlan().toString()
    lines = plan[: plan.index("Initial Plan")].split("\n") if "Initial Plan" in plan else plan.split("\n")
    # from the top down: exact join, distinct, shuffle, distinct in each task, probe
    order = [next(i for i, x in enumerate(lines) if mark in x) for mark in ("Join [canon", "HashAggregate", "Exchange hashpartitioning", "BroadcastHashJoin [_slots")]
    assert order == sorted(order)


def test_mixing(spark, odd, odd_rows, empty):
    out = collect(mixing.mix(odd).drop("text"))
    assert len(out) == len(odd_rows) + 1
    total = sum(r["size"] for r in out)
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["taken"] >= r["repeats"] * r["size"]
    assert math.isclose(sum(target.values()), total)
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate([*sorted(s for s in size if s is not None), None])}
    level = max(target[s] / weights[s] for s in size)
    for s in size:
        assert size[s] == [r["source_size"] for r in out if r["source"] == s][0]
        assert math.isclose(target[s], min(3 * size[s], level * weights[s]))
        # two rows are the same document twice
        assert abs(taken[s] - target[s]) <= 1.5
    assert out == collect(mixing.mix(odd.repartition(3)).drop("text"))
    assert mixing.mix(empty).count() == 0


MIX = "doc_id long, text string, source string, weight int, whole int, rest int, cut_key string, cut_words int, copies int, _ps string, _plan string, SIZE int, es string, key string"


@pytest.mark.parametrize("edge_rows", [50_000, 3])
def test_mixing_with_ids_that_repeat_or_are_missing(spark, monkeypatch, edge_rows):
    monkeypatch.setattr(mixing.plan, "__defaults__", (*mixing.plan.__defaults__[:-1], edge_rows))
    r = random.Random(7)
    extra = (1, 2, 3, "k", 4, 5, "p", "q", 6, "e", "y")
    rows = [(1, " ".join(words_of(r, 100)), "a", *extra) for _ in range(50)]  # one id, texts apart
    rows += [(None, " ".join(words_of(r, r.randint(0, 30))), "b", *extra) for _ in range(80)]
    rows += [(2, "same text of six words here", "c", *extra)] * 300
    rows += [(3 + i, " ".join(words_of(r, 10)), None, *extra) for i in range(40)]
    docs = spark.createDataFrame(rows, MIX)
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c != "SIZE"] + ["size", "source_size", "target", "repeats", "taken"]
    got = out.collect()
    assert Counter(x[:11] for x in got) == Counter(x[:11] for x in rows)
    taken, target = defaultdict(int), {}
    for x in got:
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.size == len((x.text or "").split()) and x.taken <= 3 * x.size
    assert all(abs(taken[s] - target[s]) <= (151 if s == "c" else 1) for s in target), (taken, target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(5)).collect()))


def test_mixing_shuffles_no_text(spark, odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_water_filling_clamps_all_when_the_budget_is_large(spark):
    s = spark.createDataFrame([("a", 10, 5), ("b", 20, 2)], "source string, source_size long, weight int")
    assert {r.source: r.target for r in mixing.water_fill(s, 3.0, 1000).collect()} == {"a": 30.0, "b": 60.0}


def test_warc_round_trip(spark):
    html = "<html><title>T &amp; t</title><p>one</p><a href=\"/x\">l</a><a class='k' href=\"/x\">m</a></html>"
    pages = spark.createDataFrame([(1, "http://a/", html, "k"), (2, None, None, "k"), (2, None, None, "k"), (3, "http://b/", "", "k")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    records = warc.derive(source, "page_id")
    assert records.count() == 8
    data = b"".join(r[0].encode() for r in records.orderBy("page_id", "warc_type").select(warc.serialize(records)).collect())
    parsed = warc.parse(data)
    blocks = {r.page_id: r.block.encode() for r in source.collect()}
    ids = {r.record_id: r.page_id for r in source.collect()}
    assert len(parsed) == 8
    for headers, block in parsed:
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        body = blocks[ids[headers["WARC-Refers-To"]]].split(b"\r\n\r\n", 1)[1]
        if headers["WARC-Type"] == "metadata":
            fields = [x.split(": ", 1) for x in block.decode().split("\r\n")[:-1]]
            assert ["source-payload-digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()] in fields
            assert ["source-header-Content-Length", str(len(body))] in fields
    first = {h["WARC-Type"]: b.decode() for h, b in parsed[:2]}
    assert first["conversion"] == "T & t one l m" and first["metadata"].startswith("title: T & t\r\n") and first["metadata"].count("outlink: /x\r\n") == 1
    assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", parsed[0][0]["WARC-Record-ID"])
    assert warc.derive(source.limit(0)).count() == 0


def test_copies_share_a_rest_to_the_word(spark):
    """Rows with one id and text, a third of all or the whole source: the words taken meet the target."""
    rows = [(1, "x", "a")] * 1000 + [(i, "one two three", "b") for i in range(2, 300)] + [(None, "w " * 7, "c")] * 333 + [(None, "w " * 7, None)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_nth", F.lit("mine"))
    for budget in (None, 1900.0, 4001.0):
        out = mixing.mix(docs, budget=budget)
        assert out.columns[:4] == docs.columns and {r._nth for r in out.collect()} == {"mine"} and out.count() == len(rows)
        for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min("taken").alias("low"), F.max("taken").alias("high"), F.max("size").alias("size")).collect():
            assert abs(r.taken - r.target) <= 0.5 + 1e-6 and r.high <= 3 * r.size
            if r.source != "b":
                assert r.high - r.low <= 1
        assert Counter(out.select("doc_id", "source", "taken").collect()) == Counter(mixing.mix(docs.repartition(3), budget=budget).select("doc_id", "source", "taken").collect())


def test_warc_carries_clashing_names_and_long_pages(spark):
    names = ("_text", "_title", "_digest", "_links", "_head", "_body", "warc_type", "Block", "_block", "refers_to")
    html = "<title>t</title><p>" + "long text " * 300_000 + "</p>"
    pages = spark.createDataFrame([(1, "http://x/", html), (None, None, None)], "page_id long, url string, html string")
    plain = warc.derive(warc.responses(pages), "page_id")
    source = warc.responses(pages).withColumns({c: F.lit("own " + c) for c in names if c != "Block"}).withColumn("Mine", F.lit("own Block"))
    out = warc.derive(source, "page_id", *[c for c in names if c != "Block"])
    mine = ["_text", "_title", "_digest", "_links", "_head", "_body", "_warc_type", "_block", "_refers_to"]
    assert out.columns == ["page_id", *mine, *warc.DERIVED]
    assert {tuple(r) for r in out.select(mine).collect()} == {tuple("own " + c for c in names if c != "Block")}
    assert Counter(map(tuple, out.drop(*mine).collect())) == Counter(map(tuple, plain.collect()))
    clash = warc.responses(pages.withColumns({"Block": F.lit("b"), "_block": F.lit("c"), "warc_date": F.lit("d")}))
    assert clash.columns == ["page_id", "url", "_Block", "__block", "_warc_date", *warc.RESPONSE]
    assert {(r._Block, r["__block"], r._warc_date) for r in clash.collect()} == {("b", "c", "d")}


@pytest.mark.parametrize("master, allowed", [("local[4]", True), ("local", True), ("local-cluster[2,1,1024]", False), ("spark://host:7077", False)])
def test_only_a_local_session_gets_a_folder_of_its_own(master, allowed):
    from unittest import mock

    from textloom.llm import common

    df = mock.MagicMock()
    df.sparkSession.sparkContext.master = master
    df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    df.sparkSession.conf.get.return_value = None
    if allowed:
        common.cut(df)
        df.sparkSession.sparkContext.setCheckpointDir.assert_called_once()
    else:
        with pytest.raises(ValueError, match="checkpoint"):
            common.cut(df)
