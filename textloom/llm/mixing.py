"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A source's target is its weight's share of the budget, clamped at max_epochs times the
source's size; what is clamped off goes to the others by weight until none is above. A
source then repeats whole as often as its target allows, and the rest comes from its
documents in seeded order, the last of them in part, so that taken words meet the target
to the word.

Documents come in the order of a key, a hash of id and text, so rows that share an id, or have none,
are apart; rows with the same id and text have one key and share what it takes, to a word alike. Nothing is
ordered globally: sizes are summed over (source, first digits of the key), the bucket in which
the rest runs out is found from those sums and summed by more digits, until it holds few rows
or one key. So a source, or a group of copies, with a third of all rows is summed map-side
and never sorted in one task. All this works on narrow rows (source, key, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh, n_words, small, text_or_empty
from textloom.llm.sharding import place

MAX_EPOCHS = 3.0
SEED = 17
WEIGHTS = (5, 2, 1)
#: Hexadecimal digits of the order key by which a bucket is split: 16 ** 3 buckets a source and level.
BUCKET_DIGITS, KEY_DIGITS = 3, 32
#: Rows of a source that may be put in order in one task.
EDGE_ROWS = 50_000


def order_key(doc_id: Column, text: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text), F.lit(""))))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source (by code point, null last) with the weights in turn. One row per source: a mixture
    specification, not data."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """source, source_size, weight to these and target.

    In order of cap by weight, the sources before the first that stays under its cap are
    clamped; that one's level holds for all the rest. A budget above all caps clamps all.
    """
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everyone).cast("double")
    s = sources.withColumns({"cap": F.lit(float(max_epochs)) * F.col("source_size"), "total": total})
    s = s.withColumns({
        "before": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "weights": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn("level", (F.col("total") - F.col("before")) / F.col("weights"))
    s = s.withColumn("common", F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("v")))).over(everyone)["v"])
    target = F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("common")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def plan(docs: DataFrame, weights=cyclic_weights, max_epochs: float = MAX_EPOCHS, seed: int = SEED, budget: float | None = None, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """Per source: source_size, target, whole repetitions, and where the rest runs out: cut_key, whose copies rows share cut_words.

    docs: doc_id, source, text. weights: a function of the distinct sources to (source, weight).
    """
    rows = cut(docs.select("source", n_words(text_or_empty()).alias("size"), order_key(F.col("doc_id"), F.col("text"), seed).alias("key")))

    def sums(of: DataFrame, digits: int) -> DataFrame:
        by = F.substring("key", 1, digits).alias("bucket")
        return cut(of.groupBy("source", by).agg(F.sum("size").alias("words"), F.count("*").alias("n")))

    buckets = sums(rows, BUCKET_DIGITS)
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    given = weights(sizes.select("source")).select(F.col("source").alias("gs"), "weight")
    filled = water_fill(sizes.join(given, _same("source", "gs")).select("source", "source_size", "weight"), max_epochs, budget)
    quota = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    filled = cut(filled.withColumn("whole", whole).withColumn("rest", quota - F.col("whole") * F.col("source_size")))
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge, digits = filled.select(F.col("source").alias("es"), F.lit("").alias("eb"), F.lit(0).cast("bigint").alias("start"), "rest"), BUCKET_DIGITS

    def inside() -> DataFrame:
        return rows.join(small(edge), _same("source", "es") & F.startswith(F.col("key"), F.col("eb"))).select("source", "key", "size")

    while True:
        at = buckets.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
        at = at.join(small(edge.select("es", "start", "rest")), _same("source", "es")).withColumn("before", F.col("start") + F.col("before"))
        at = at.filter("before <= rest AND rest < before + words")
        edge = cut(at.select(F.col("source").alias("es"), F.col("bucket").alias("eb"), F.col("before").alias("start"), "rest", F.col("n").alias("en")))
        if digits >= KEY_DIGITS or (edge.agg(F.max("en")).first()[0] or 0) <= edge_rows:
            break
        digits = min(KEY_DIGITS, digits + BUCKET_DIGITS)
        buckets = sums(inside(), digits)
    keys = inside().groupBy("source", "key").agg(F.count("*").alias("copies"), F.sum("size").alias("words")).join(small(edge.select("es", "start", "rest")), _same("source", "es"))
    o = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    last = keys.withColumn("so_far", F.col("start") + F.coalesce(F.sum("words").over(o), F.lit(0))).filter("so_far <= rest AND rest < so_far + words")
    last = last.select(F.col("source").alias("ls"), F.col("key").alias("cut_key"), (F.col("rest") - F.col("so_far")).alias("cut_words"), "copies")
    return cut(filled.join(last, _same("source", "ls"), "left").drop("ls"))


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED, weights=cyclic_weights, budget: float | None = None) -> DataFrame:
    """docs with size, source_size, target, repeats (whole copies) and taken (words with repeats).

    Null or empty text has size 0 and takes 0; a null source is a source of its own; an empty
    table gives no rows. Rows that share an id, or have none, count one by one; rows with the same
    id and text are taken alike, but for a word more of some where a rest must be shared, so the words of a
    source meet its target to the word. Columns
    of docs with the names of the results are replaced, all others stay. The text isn't shuffled: the
    plan, a row a source, joins the scan (broadcast if it is small).
    """
    mine = ["size", "source_size", "target", "repeats", "taken"]
    kept = docs.drop(*mine)
    name, nth = fresh(kept, "_plan"), fresh(kept, "_nth")
    p = plan(docs.select("doc_id", "source", "text"), weights, max_epochs, seed, budget)
    j = kept.join(small(p.select(F.struct(*p.columns).alias(name))), F.col("source").eqNullSafe(F.col(name)["source"]))
    of = {c: F.col(name)[c] for c in p.columns}
    key, size = order_key(F.col("doc_id"), F.col("text"), seed), F.col("size")
    # of the copies that share what is left, the first take a word more, if it can't be shared alike
    each, over = F.floor(of["cut_words"] / of["copies"]), F.pmod(of["cut_words"], of["copies"])
    part = F.least(size, each + F.when(F.col(nth) < over, 1).otherwise(0))
    extra = F.when(of["cut_key"].isNull() | (key > of["cut_key"]), 0).when(key < of["cut_key"], size).otherwise(part)
    if p.filter("pmod(cut_words, copies) > 0").isEmpty():
        j = j.withColumn(nth, F.lit(0))
    else:  # only rows of the keys that share a rest are numbered, and they by counted ranges, as they may be many
        last, group = F.coalesce(key == of["cut_key"], F.lit(False)), fresh(j, "_group")
        shared = j.filter(last).withColumn(group, F.concat(F.coalesce(F.concat(F.lit("="), of["source"]), F.lit("?")), F.lit(" "), key))
        j = j.filter(~last).withColumn(nth, F.lit(0).cast("bigint")).unionByName(place(shared, group, [], nth).drop(group))
    out = j.withColumn("size", n_words(text_or_empty())).withColumns({"source_size": of["source_size"], "target": of["target"], "repeats": of["whole"]})
    return out.withColumn("taken", (F.col("repeats") * size + extra).cast("bigint")).select(*kept.columns, *mine)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
b AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM c),
l AS (SELECT *, (total - prior) / ws AS level FROM b),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap > w * level)) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target + 0.5) / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS rest FROM q),
g AS (SELECT source, k, count(*) AS copies, sum(size) AS words FROM d GROUP BY source, k),
o AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM g)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN rest >= prior + words THEN size WHEN rest <= prior THEN 0
  ELSE least(size, (rest - prior) // copies + CASE WHEN row_number() OVER (PARTITION BY d.source, d.k) <= (rest - prior) % copies THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM d JOIN o ON d.k = o.k AND d.source IS NOT DISTINCT FROM o.source JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
