"""Profiles that are kept and merged (P4, P5, P6, P10): only new files are read.

The state of a part (a file, a day) is one row: its number of rows and, for every column, the nulls, the typed minimum and maximum and a
HyperLogLog sketch of the values. States add up: the profile of a table is the sum, minimum, maximum and union over
its parts, so a table that grows by files or days is profiled from the new ones and the stored states of the others. Counts, minima and maxima are exact;
numbers of distinct values lie within the sketch's error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.common import ratio4
from kiln.operators.profile import groupable_columns
from kiln.sources.attach import list_folder

#: Buckets of a sketch (a power of two) and its relative standard error.
SKETCH_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_K / 2)
_SKETCHED = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _sketched(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return c if isinstance(field.dataType, _SKETCHED) else c.cast("string")


def _profiled(df: DataFrame, part: str) -> list[T.StructField]:
    names = set(groupable_columns(df)) - {part}
    return [f for f in df.schema.fields if f.name in names]


def part_states(df: DataFrame, part: str) -> DataFrame:
    """One row for each value of the column ``part``: part, rows, and per other column ``i`` n_i, lo_i, hi_i (typed) and s_i (sketch).

    One pass; a part's partial states are what is shuffled, whatever its number of rows.
    """
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(_profiled(df, part)):
        c = F.col(f"`{f.name}`")
        aggs += [F.count_if(c.isNull()).alias(f"n_{i}"), F.min(c).alias(f"lo_{i}"), F.max(c).alias(f"hi_{i}")]
        aggs.append(F.hll_sketch_agg(_sketched(f), F.lit(SKETCH_K)).alias(f"s_{i}"))
    return df.groupBy(F.col(f"`{part}`").cast("string").alias("part")).agg(*aggs)


def known_parts(spark: SparkSession, path: str) -> set[str]:
    """The parts whose states are stored under ``path`` (part names only)."""
    try:
        if not any(n.endswith(".parquet") for n in list_folder(spark, path)):
            return set()
    except Exception:  # no such folder yet
        return set()
    return {r.part for r in spark.read.parquet(path).select("part").distinct().collect()}


def update_states(spark: SparkSession, path: str, parts: list[str], read: Callable[[list[str]], DataFrame], part: str = "part") -> list[str]:
    """Add the states of those ``parts`` that ``path`` has none of; returns them.

    ``read`` gives the rows of the parts asked for, with their part in the column ``part``; the others are not read. The new states
    appear together when all are written; a failed update adds none and can be repeated. A part without rows gets
    no state and is asked for again.
    """
    new = sorted(set(parts) - known_parts(spark, path))
    if new:
        part_states(read(new), part).coalesce(1).write.mode("append").parquet(path)  # a row per part
    return new


def read_files(spark: SparkSession, schema: T.StructType | None = None) -> Callable[[list[str]], DataFrame]:
    """A reader for :func:`update_states` whose parts are parquet files or folders, each by its path."""

    def read(paths: list[str]) -> DataFrame:
        out = None
        for p in paths:
            one = (spark.read.schema(schema) if schema else spark.read).parquet(p).withColumn("part", F.lit(p))
            out = one if out is None else out.unionByName(one)
        return out

    return read


def merged_profile(states: DataFrame, like: DataFrame, part: str = "part", table_name: str = "") -> DataFrame:
    """The profile of all parts, as :func:`kiln.operators.profile.column_stats` gives it with ``approx``.

    ``like`` has the table's columns (no row is read). Columns: table_name, position, column_name, data_type, row_count,
    null_count, null_rate, unique_count (estimated), is_unique_candidate (null within the error), min_value, max_value. A part stored
    twice, by two updates at once, counts once.
    """
    fields = _profiled(like, part)
    aggs = [F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("row_count")]
    for i, _ in enumerate(fields):
        aggs += [F.coalesce(F.sum(f"n_{i}"), F.lit(0)).cast("long").alias(f"n_{i}"), F.min(f"lo_{i}").cast("string").alias(f"lo_{i}")]
        aggs += [F.max(f"hi_{i}").cast("string").alias(f"hi_{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"s_{i}")).alias(f"d_{i}")]
    wide = states.dropDuplicates(["part"]).agg(*aggs)
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"n_{i}").alias("null_count"), F.coalesce(f"d_{i}", F.lit(0)).alias("unique_count"),
            F.col(f"lo_{i}").alias("min_value"), F.col(f"hi_{i}").alias("max_value"),
        )
        for i, f in enumerate(fields)
    ]
    long = wide.select("row_count", F.inline(F.array(*rows)))
    filled = F.col("row_count") - F.col("null_count")
    near = F.abs(F.col("unique_count") - F.col("row_count")) <= 3 * SKETCH_ERROR * F.col("row_count")
    unique = F.when((F.col("null_count") > 0) | (F.col("row_count") == 0) | ~near, F.lit(False))
    return long.select(
        F.lit(table_name).alias("table_name"), "position", "column_name", "data_type", "row_count", "null_count",
        ratio4("null_count", "row_count").alias("null_rate"), F.least("unique_count", filled).alias("unique_count"),
        unique.alias("is_unique_candidate"), "min_value", "max_value",
    )
