"""The corpus pipeline: documents through five operators, each on all that the one before kept.

Stages take and return the columns of documents; the last adds what the mix takes of each.
SQL can't express the classifier, MinHash or the latent search, so there is no ORACLE_SQL; tests hold
the near-duplicate stage against brute force and the others against planted cases. Every stage takes
nulls in any column, repeated rows, empty tables and extra columns, which it passes on as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, line_dedup, minhash, mixing, quality_classifier
from textloom.llm.common import WORD, cut, fresh, read

ORACLE_SQL = None

#: Near copies are pairs at a similarity of 0.8 or more over five-word shingles. Such a pair meets in some
#: table with probability (1 - (1 - 0.8 ** 3) ** 11) ** 2 = 0.999; op10's 8 collections would give 0.994.
NEAR_PERCENT, NEAR_COLLECTIONS = 80, 11


def keyed(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs with three columns more, and their names: a hash of the text, one of id and text, and one of every column; null is a value of its own."""
    value = lambda c: [F.col(c).isNull(), F.col(c)]
    row = F.xxhash64(*value("doc_id"), *value("text"))
    every = F.xxhash64(F.lit(1), *[v for c in docs.columns for v in value(c)])
    names = [fresh(docs, x) for x in ("_text", "_row", "_all")]
    return docs.withColumns(dict(zip(names, (F.xxhash64(*value("text")), row, every), strict=True))), *names


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts, each by its own text: rows that share an id, null included, are judged apart.

    Without labels of both kinds no document reaches the threshold and none is kept.
    """
    labels = quality_classifier.learning_labels(read(spark, sf_dir, "labels"))
    rows, _, key, _ = keyed(docs)
    # the classifier's id is the row's key, so labels take the keys of the rows that have their id
    of_rows = rows.select("doc_id", F.col(key).alias("k")).distinct().join(labels, "doc_id").select(F.col("k").alias("doc_id"), "y")
    scored = quality_classifier.score(rows.select(F.col(key).alias("doc_id"), "text"), of_rows)
    accepted = scored.filter("predicted = 1").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(accepted, key, "left_semi").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate; a document of which nothing is left goes. n_chars, if there, follows the text."""
    own = {c: fresh(docs, "_own_" + c) for c in docs.columns if c in ("n_lines", "n_removed")}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own)).filter((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the least id, once.

    A null id comes after all others; ties go by text hash. Texts without words are in no
    group: of rows that share id and text one stays. Rows that share an id but not the text are
    documents of their own.
    """
    rows, text, row, every = keyed(docs)
    narrow = rows.select("doc_id", "text", F.col(text).alias("_text"), F.col(row).alias("_row"), F.col(every).alias("_all"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text", "_all")
    texts = narrow.filter(worded).select(F.col("_text").alias("doc_id"), "text").distinct()
    groups = minhash.components(texts, NEAR_PERCENT, NEAR_COLLECTIONS).select(F.col("doc_id").alias("_text"), "component_id")
    firsts = narrow.filter(worded).groupBy("_text").agg(F.min(order).alias("first")).join(groups, "_text")
    kept = firsts.groupBy("component_id").agg(F.min("first").alias("first")).select("first._text", "first._all")
    bare = narrow.filter(~worded).groupBy("_row", "_text").agg(F.min("_all").alias("_all")).select("_text", "_all")
    chosen = kept.unionByName(bare).select(F.col("_text").alias(text), F.col("_all").alias(every))
    return rows.join(chosen, [text, every], "left_semi").dropDuplicates([text, every]).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give away no benchmark item, whatever their ids."""
    rows, _, key, _ = keyed(docs)
    found = decontamination.leaks(rows.select(F.col(key).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    return rows.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with size, source_size, target, repeats (whole copies) and taken (words with repeats); none goes.

    Sources, null among them, are weighed in turn and repeat at most three times; rows that share an
    id, or have none, count one by one.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
