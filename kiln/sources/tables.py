"""Read the input tables and expose them as the row layer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, base: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table of a folder source: ``<base>/<name>.<fmt>``; lazy, pruned and filtered at the scan."""
    return spark.read.format(fmt).load(f"{base.rstrip('/')}/{name}.{fmt}")


def read_tables(spark: SparkSession, base: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: read_table(spark, base, n) for n in (names or TABLES)}


def view_name(prefix: str, source_id: str, table: str) -> str:
    """``row_<source>_<table>``, lower case, spaces and dots to ``_`` (source id keeps two sources apart)."""
    clean = lambda s: re.sub(r"[\s.\-]+", "_", s.strip().lower())
    return f"{prefix}_{clean(source_id)}_{clean(table)}"


def row_view(spark: SparkSession, source_id: str, table: str, df: DataFrame) -> str:
    """Pass-through view of one source table; returns the view name."""
    name = view_name("row", source_id, table)
    df.createOrReplaceTempView(name)
    return name
