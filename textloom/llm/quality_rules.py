r"""Quality rules under weak supervision: rules vote good, bad or abstain; expectation-maximisation
estimates how each rule votes on good and on bad documents; the posterior decides.

Bad documents are of several kinds, each seen by some rules and passed by the others. With one
class for them all, EM takes the commonest kind for "bad" and gives the rest to the good class;
so there is a kind for each rule to start from, and all of their tables are estimated.

All in native expressions: words, symbols, repeated lines and windows are array functions
within the row, so nothing is shuffled but the histogram of vote patterns (at most 3 ** rules
rows), from which the driver runs EM. The fitted model comes back as literals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import WORD, cut, text_or_empty, word_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
ITERATIONS = 60
#: What is believed before a vote is seen of rules on good documents, on bad ones, and of a rule on the bad ones of
#: its own kind. It weighs as much as PSEUDO documents, whatever their number, and is where the estimation starts:
#: a bad vote that others contradict is taken for a false alarm until the data say otherwise.
GOOD, BAD, OWN = {1: 0.95, -1: 0.05}, {1: 0.5, -1: 0.5}, {1: 0.05, -1: 0.95}
PRIOR = 0.8
PSEUDO = 2.0
THRESHOLD = 0.5

#: (name, ratio, good up to, bad from): in between a rule abstains.
CEILINGS = [
    ("symbols", "n_symbols / n_words", 0.05, 0.25),
    ("repeated_lines", "n_dup_lines / n_lines", 0.1, 0.4),
    ("repeated_words", "n_repeat_words / n_words", 0.2, 0.5),
    ("capitals", "n_capitals / word_chars", 0.15, 0.35),
    ("exclamations", "n_exclamations / n_words", 0.05, 0.3),
]
#: (name, ratio, bad up to, good from)
FLOORS = [("plain_words", "n_plain / n_words", 0.7, 0.9)]
#: (name, ratio, bad up to, good from, good up to, bad from)
BANDS = [("word_length", "word_chars / n_words", 2.0, 3.0, 11.0, 16.0)]


#: Letters or digits, with a mark between them, one before and two after at most.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{P}?[\p{L}\p{M}\p{N}]++(?:\p{P}[\p{L}\p{M}\p{N}]++)*+\p{P}{0,2}(?![^\x20\x09-\x0D])"
COUNTED = r"[^\p{Lu}#*$%&|<>!\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def _without(c: Column, characters: str) -> Column:
    return F.length(c) - F.length(F.translate(c, characters, ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts, as long. Null text counts as empty."""
    d = docs.select("doc_id", text_or_empty().alias("t"))
    # one regular expression leaves only the characters that are counted; the rest works on those few
    few = F.regexp_replace("t", COUNTED, "")
    d = d.select(
        "doc_id",
        word_array(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("l"),
        F.length("t").alias("chars"),
        few.alias("few"),
        F.regexp_count("t", F.lit(PLAIN)).alias("n_plain"),
    )
    n = F.size("w")
    zipped = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(n, F.lit(1))).alias("c"))
    windows = F.transform(zipped, lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    d = d.withColumn("n_words", n).withColumn("s", F.sort_array(F.slice(windows, 1, F.greatest(n - 2, F.lit(0)))))
    # neighbours in hash order that are equal mark the three words of both windows
    marks = F.zip_with(
        F.col("s"), F.slice("s", 2, F.greatest(F.size("s"), F.lit(1))),
        lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], x["i"] + 1, x["i"] + 2, y["i"], y["i"] + 1, y["i"] + 2)),
    )
    repeated = F.size(F.array_distinct(F.flatten(F.array_compact(marks))))
    out = {
        "n_words": F.col("n_words"), "word_chars": F.col("chars") - _without(F.col("few"), BLANKS), "n_symbols": _without(F.col("few"), SYMBOLS),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_repeat_words": repeated,
        "n_lines": F.size("l"), "n_capitals": F.length(F.translate("few", SYMBOLS + BLANKS + "!", "")), "n_exclamations": _without(F.col("few"), "!"),
        "n_plain": F.col("n_plain"),
    }
    return d.select("doc_id", *[c.cast("bigint").alias(k) for k, c in out.items()])


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains; also where a ratio has no denominator."""
    out = {}
    for name, ratio, good, bad in CEILINGS:
        r = F.expr("try_divide({}, {})".format(*ratio.split(" / ")))
        out[name] = F.when(r <= good, 1).when(r >= bad, -1).otherwise(0)
    for name, ratio, bad, good in FLOORS:
        r = F.expr("try_divide({}, {})".format(*ratio.split(" / ")))
        out[name] = F.when(r >= good, 1).when(r <= bad, -1).otherwise(0)
    for name, ratio, bad_low, good_low, good_high, bad_high in BANDS:
        r = F.expr("try_divide({}, {})".format(*ratio.split(" / ")))
        out[name] = F.when((r <= bad_low) | (r >= bad_high), -1).when((r >= good_low) & (r <= good_high), 1).otherwise(0)
    return {f"vote_{k}": v for k, v in out.items()}


Table = dict[int, float]


def shares(cast: tuple[int, ...], weights: list[float], tables: list[list[Table]]) -> list[float]:
    """E step: the probability of each kind of document, good ones first, given the votes cast. A rule that abstains says nothing."""
    p = [w * math.prod(t[v] for t, v in zip(side, cast, strict=True) if v) for w, side in zip(weights, tables, strict=True)]
    return [x / sum(p) for x in p]


def fit(patterns: list[tuple[tuple[int, ...], int]], iterations: int = ITERATIONS, prior: float = PRIOR) -> dict:
    """EM over (votes, number of documents) for good documents and a kind of bad ones for each rule.

    Given its kind a document's votes are independent. Everything is estimated: how common each kind
    is, and for each kind and rule how often a vote it casts is good or bad, false alarms on good
    documents and a rule's votes on its own kind included. A rule's accuracy is the share of the
    votes it casts that are right. One whose bad votes no other rule bears out turns out to give
    false alarms, and its vote alone rejects nothing.
    Returns weights (good, then kinds), tables (kind, rule, vote) and accuracy (by rule; 0.5 for one that never votes).
    """
    m = len(patterns[0][0]) if patterns else 0
    start = [prior] + [(1 - prior) / max(m, 1)] * m
    belief = [[GOOD] * m] + [[OWN if k == j else BAD for j in range(m)] for k in range(m)]
    weights, tables = start, belief
    total = sum(n for _, n in patterns)
    for _ in range(iterations if total else 0):
        mass = [PSEUDO * w for w in start]
        sums = [[{v: PSEUDO * x for v, x in t.items()} for t in side] for side in belief]
        for cast, n in patterns:
            for k, x in enumerate(shares(cast, weights, tables)):
                mass[k] += n * x
                for j, v in enumerate(cast):
                    if v:
                        sums[k][j][v] += n * x
        weights = [x / (total + PSEUDO) for x in mass]
        tables = [[{v: x / sum(t.values()) for v, x in t.items()} for t in side] for side in sums]
    accuracy = []
    for j in range(m):
        good, bad, (passed, caught) = tables[0][j], tables[1:], (0.0, 0.0)
        for w, side in zip(weights[1:], bad, strict=True):
            passed, caught = passed + w * side[j][1], caught + w * side[j][-1]
        right, wrong = weights[0] * good[1] + caught, weights[0] * good[-1] + passed
        accuracy.append(right / (right + wrong) if right + wrong else 0.5)
    return {"weights": weights, "tables": tables, "accuracy": accuracy}


def posterior(model: dict, names: list[str]) -> Column:
    """The probability of good, as an expression of the vote columns."""
    bad = F.lit(0.0)
    for weight, side in list(zip(model["weights"], model["tables"], strict=True))[1:]:
        odds = F.lit(math.log(weight / model["weights"][0]))
        for name, kind, good in zip(names, side, model["tables"][0], strict=True):
            by = {v: math.log(kind[v] / good[v]) for v in (1, -1)}
            odds = odds + F.when(F.col(name) == 1, by[1]).when(F.col(name) == -1, by[-1]).otherwise(0.0)
        bad = bad + F.exp(odds)
    return 1 / (1 + bad)


def judge(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, the votes, quality (posterior) and kept.

    Null and empty texts have no words and fail the base rule; rules without a denominator
    abstain; repeated rows are judged alike; an empty table gives no rows. Votes are counted
    over all documents.
    """
    f = cut(features(docs))  # narrow rows; the texts are read once
    v = votes()
    voted = f.withColumns(v)
    names = list(v)
    counts = voted.groupBy(*names).count().collect()  # at most 3 ** rules rows
    model = fit(sorted((tuple(r[n] for n in names), r["count"]) for r in counts))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = voted.withColumns({"base_failed": failed, "quality": posterior(model, names)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    out = judge(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
