"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import shared_dir

#: A word: a run without ASCII white space (space, tab, line feed, vertical tab, form feed, return).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several
    passes read a narrow table instead of computing it again.
    """
    spark = df.sparkSession
    path = shared_dir(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000


def keep_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``ids`` (one column of that name).

    Up to ``BROADCAST_IDS`` ids, counted here, are broadcast, so that wide rows are filtered where they are read; more are joined by
    a shuffle.
    """
    ids = materialise(ids.select(key).distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null. Counts the starts of runs without splitting the text into an array."""
    blanked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(blanked, SPACE, "")).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes (null counts as empty)."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def held_out(doc_id: Column, mod: int, part: int) -> Column:
    """True where crc32 of the id's decimal text leaves ``part`` modulo ``mod`` (null id: false)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % mod == part, F.lit(False))


#: Rows in one Arrow batch: bounds the memory a Python worker needs for a batch of long texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows`` where it is larger (the default of 10,000 rows ignores their size)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
