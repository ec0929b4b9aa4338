r"""Line dedup by distinct-site spread: lines on many sites are boilerplate and stay only where they come first.

Each line (trimmed, not blank) is a 128-bit hash. HyperLogLog sketches of its sites merge by
aggregation, map-side first, so a line that every document has costs one small sketch a task.
Lines whose estimate is within BAND of the threshold are counted exactly; the others are
decided by their estimate, whose standard error is 1.6 % at 2 ** 12 registers. Only lines
that might be boilerplate are joined back to their places. What such a join takes from an
aggregation is written first; it's broadcast if it is small, else its other side is dealt by a
shuffle of its own, of which Spark splits the partition of a line that a third of all rows have.

The first place (smallest doc_id, then text hash, then position) keeps its copy, so of a
group of copied documents the first stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, fresh, small

MIN_SITES = 10
BAND = 0.1
LG_K = 12
BLANKS = " \t\r\x0b\x0c"


def _keys() -> dict[str, Column]:
    """A document's identity: repeated rows with one id and one text are treated alike."""
    return {"_k1": F.xxhash64("doc_id"), "_k2": F.xxhash64("text")}


def line_rows(docs: DataFrame) -> DataFrame:
    """doc_id, keys, site, pos and hash (h1, h2) of each line that isn't blank. A null source is a site of its own."""
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("?"))
    rows = docs.select("doc_id", *[c.alias(k) for k, c in _keys().items()], site.alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim(F.col("line"), F.lit(BLANKS))).filter("line <> ''")
    return rows.select("doc_id", "_k1", "_k2", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate_places(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """_k1, _k2, pos of each line to remove."""
    lines = line_rows(docs)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("est"))
    wide = cut(spread.filter(F.col("est") >= min_sites * (1 - band)))
    places = cut(lines.join(small(wide), ["h1", "h2"]))
    near = places.filter(F.col("est") <= min_sites * (1 + band)).groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"))
    dropped = near.filter(F.col("sites") < min_sites).select("h1", "h2")
    here = F.struct("doc_id", "_k2", "pos")
    first = cut(places.groupBy("h1", "h2").agg(F.min(here).alias("first")).join(dropped, ["h1", "h2"], "left_anti"))
    return places.join(small(first), ["h1", "h2"]).filter(~here.eqNullSafe(F.col("first"))).select("_k1", "_k2", "pos")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """docs with the remaining text, and n_lines and n_removed (lines; replaced if docs has them).

    docs: doc_id, source, text and any more, whatever their names. Null text stays null, with 0 and 0;
    an empty text has one line, blank, and stays; blank lines are never removed; rows that repeat
    id and text are treated alike; an empty table gives no rows. The lines to remove meet their
    document in one join on its key, so a document is the largest group there is.
    """
    gone = boilerplate_places(docs.select("doc_id", "source", "text"), min_sites, band)
    order = docs.drop("n_lines", "n_removed").columns
    k1, k2, split, out = (fresh(docs, x) for x in ("_k1", "_k2", "_lines", "_gone"))
    gone = cut(gone.groupBy(F.col("_k1").alias(k1), F.col("_k2").alias(k2)).agg(F.collect_set("pos").alias(out)))
    keys = dict(zip((k1, k2), _keys().values(), strict=True))
    # lines are split below the join, so that expressions above it address them as a column
    rows = docs.withColumns({**keys, split: F.split("text", "\n", -1)}).drop("text", "n_lines", "n_removed")
    j = rows.join(gone, [k1, k2], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(out))
    kept = F.transform(left, lambda i: F.get(F.col(split), i))
    text = F.when(F.col(out).isNull(), F.array_join(split, "\n")).otherwise(F.array_join(kept, "\n"))
    counts = {
        "n_lines": F.coalesce(F.when(F.col(split).isNotNull(), F.size(split)), F.lit(0)).cast("bigint"),
        "n_removed": F.coalesce(F.when(F.col(out).isNotNull(), F.size(out)), F.lit(0)).cast("bigint"),
    }
    return j.withColumns({"text": text, **counts}).select(*order, "n_lines", "n_removed")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP2_SQL = """
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
b AS (SELECT line, min((doc_id, pos)) AS first FROM t WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '?')) >= 10),
k AS (SELECT doc_id, pos, raw, b.line IS NOT NULL AND (doc_id, pos) <> b.first AS gone FROM t LEFT JOIN b ON t.line = b.line),
d AS (SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept_sha256 FROM documents LEFT JOIN d USING (doc_id)
"""
