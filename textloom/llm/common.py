"""What the operators share: reading tables, words, and cutting lineage."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: what follows survives lost executors.

    The folder is the session's spark.checkpoint.dir. Only a local session (tests, one machine) gets
    a temporary one; on a cluster, local-cluster too, a missing setting is an error. What df's own shuffles left on
    disk goes when the driver has collected its garbage, which is asked for here.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="textloom-"))
    out = df.checkpoint(eager=True)
    del df
    gc.collect()
    context._jvm.System.gc()
    return out


#: Rows of a few numbers or short strings, some MB: what a join may broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, which cut() has written, with a broadcast hint if it has at most so many rows; larger ones are shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have; case doesn't make a difference."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem = "_" + stem
    return stem
