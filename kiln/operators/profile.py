"""Profiling (P1-P13): a wide pass and one value exchange per table, not five statements per column.

* a **wide** aggregate gives the row count and per column null count, typed min/max and, with ``approx=True``,
  the approximate distinct count: fixed-size partial results, no value shuffle;
* a **long** aggregate unpivots every groupable column to ``(column_name, value)`` and groups it, with map-side
  partial aggregation, so a value that holds a third of the table collapses to one row per task before
  the shuffle. Exact distinct counts, top values and samples come from this one ``value_counts`` frame;
  inside one query Spark reuses its exchange.

Top-k and sample ranking use ``row_number() <= k`` over ``column_name``; Spark plans that as a partial
``WindowGroupLimit`` before the shuffle, so no task ever holds more than ``k`` rows per column and partition.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.common import fixed_expr, ratio4
from kiln.sources.ods import run_per_table

log = logging.getLogger(__name__)

#: Types without an order or equality Spark can group by: they get counts only.
_COUNTS_ONLY = (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType)
#: The sketch's relative standard deviation (Spark's default), and how many of them count as within its error.
SKETCH_RSD, SKETCH_SIGMAS = 0.05, 3
#: Values (rows by columns) of one partition that are unpivoted and grouped as they are.
TASK_VALUES = 4_000_000


def _fields(df: DataFrame, columns: list[str] | None = None) -> list[T.StructField]:
    wanted = set(columns) if columns else None
    return [f for f in df.schema.fields if wanted is None or f.name in wanted]


def groupable_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns whose values can be grouped (skip map/array/struct: counts only)."""
    return [f.name for f in _fields(df, columns) if not isinstance(f.dataType, _COUNTS_ONLY)]


def row_count(df: DataFrame) -> DataFrame:
    """One row, ``row_count``."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def null_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P2 + P3 on their own: column_name, row_count, null_count, null_rate (0.0 on an empty table).

    One aggregate pass over all columns (``count_if`` per column, no shuffle
    but the one-row partials), then one row per column in schema order.
    """
    fields = _fields(df, columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.col(f"n{i}").alias("null_count")) for i, f in enumerate(fields)])
    long = wide.select(F.col("__rows").alias("row_count"), F.inline(rows))
    return long.select(
        "column_name", "row_count", F.col("null_count").cast("long").alias("null_count"), ratio4("null_count", "row_count").alias("null_rate")
    )


def _slots(fields: list[T.StructField]) -> dict[str, tuple[str, T.DataType]]:
    """One typed slot per distinct column type: ``{type string: (slot name, type)}``."""
    out: dict[str, tuple[str, T.DataType]] = {}
    for f in fields:
        key = f.dataType.simpleString()
        if key not in out:
            out[key] = (f"v{len(out)}", f.dataType)
    return out


def typed_values(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Unpivot groupable columns to ``(column_name, value)`` keeping their types.

    ``value`` is a struct with one field per distinct column type; a row fills
    only its own column's field, so nothing is formatted as text before the
    aggregation. Returns the frame and the slot names.
    """
    fields = [f for f in _fields(df, columns) if not isinstance(f.dataType, _COUNTS_ONLY)]
    if not fields:
        raise ValueError("no groupable columns to profile")
    slots = _slots(fields)
    nulls = {name: F.lit(None).cast(key).alias(name) for key, (name, _) in slots.items()}  # built once, shared

    kind = T.StructType([T.StructField(name, t) for name, t in slots.values()])

    def packed(f: T.StructField) -> Column:
        mine = slots[f.dataType.simpleString()][0]
        parts = [F.col(f"`{f.name}`").alias(name) if name == mine else nulls[name] for name, _ in slots.values()]
        # every slot nullable, also that of a NOT NULL column: unpivot takes the first struct's nullability for all of them
        return F.struct(*parts).cast(kind).alias(f.name)

    names = [f"`{f.name}`" for f in fields]
    long = df.select(*[packed(f) for f in fields]).unpivot([], names, "column_name", "value")
    return long, [name for name, _ in slots.values()]


def _value_text(slot_names: list[str]) -> Column:
    return F.coalesce(*[F.col("value")[n].cast("string") for n in slot_names])


def _value_is_null(slot_names: list[str]) -> Column:
    cond = F.col("value")[slot_names[0]].isNull()
    for n in slot_names[1:]:
        cond = cond & F.col("value")[n].isNull()
    return cond


def spread_rows(df: DataFrame) -> DataFrame:
    """``df``, its rows dealt out evenly if a partition holds more than ``TASK_VALUES`` values (rows by columns).

    A small file of many short rows is read by one task, whose map of distinct values would otherwise grow with the table.
    The rows of each partition are counted by a job of their own, which reads no column.
    """
    width = max(1, len(df.columns))
    parts = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts, rows, most = parts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if most * width <= TASK_VALUES:
        return df
    return df.repartition(max(parts, -(-rows * width // TASK_VALUES)))


def typed_counts(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """``(column_name, value struct, count)``: one partial-aggregated shuffle for all columns."""
    wanted = groupable_columns(df, columns)
    long, slot_names = typed_values(spread_rows(df.select(*[F.col(f"`{c}`") for c in wanted])) if wanted else df, columns)
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count")), slot_names


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unpivot groupable columns to ``(column_name, value: string)``; NULL stays NULL."""
    long, slot_names = typed_values(df, columns)
    return long.select("column_name", _value_text(slot_names).alias("value"))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value: string, count)`` with NULL as its own group.

    Grouped on typed values; only the distinct values are formatted as text.
    """
    counts, slot_names = typed_counts(df, columns)
    return counts.select("column_name", _value_text(slot_names).alias("value"), "count")


def _wide_stats(df: DataFrame, fields: list[T.StructField], approx: bool) -> DataFrame:
    aggs: list[Column] = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count_if(c.isNull()).alias(f"n{i}"))
        orderable = not isinstance(f.dataType, _COUNTS_ONLY)
        aggs.append((F.min(c).cast("string") if orderable else F.lit(None).cast("string")).alias(f"lo{i}"))
        aggs.append((F.max(c).cast("string") if orderable else F.lit(None).cast("string")).alias(f"hi{i}"))
        if approx and not isinstance(f.dataType, _COUNTS_ONLY):
            aggs.append(F.approx_count_distinct(c).alias(f"u{i}"))
        else:
            aggs.append(F.lit(None).cast("long").alias(f"u{i}"))
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.col(f"n{i}").alias("null_count"),
                    F.col(f"lo{i}").alias("min_value"),
                    F.col(f"hi{i}").alias("max_value"),
                    F.col(f"u{i}").alias("approx_unique"),
                )
                for i, f in enumerate(fields)
            ]
        )
    )
    return wide.select(F.col("__rows").alias("row_count"), rows.alias("s")).select("row_count", "s.*")


def column_stats(
    df: DataFrame,
    table_name: str = "",
    columns: list[str] | None = None,
    approx: bool = False,
    counts: DataFrame | None = None,
) -> DataFrame:
    """P1-P6 per column: one row per column, in schema order.

    Columns: table_name, position, column_name, data_type, row_count,
    null_count, null_rate, unique_count, is_unique_candidate, min_value,
    max_value. ``unique_count`` is exact (NULL excluded) unless ``approx``.
    Map, array, struct, binary and variant columns get counts only (unique_count NULL).

    One wide pass gives everything but the exact distinct counts, which come from the typed long form. With
    ``approx`` the distinct count is a sketch's estimate; ``is_unique_candidate`` is then NULL (not known) where the
    estimate lies within the sketch's error of the row count, to be confirmed with ``approx=False`` on these columns.
    ``counts`` are the table's :func:`value_counts` where the caller has them.
    """
    fields = _fields(df, columns)
    stats = _wide_stats(df, fields, approx)
    groupable = [f.name for f in fields if not isinstance(f.dataType, _COUNTS_ONLY)]
    if approx or not groupable:
        stats = stats.withColumn("unique_count", F.col("approx_unique"))
        near = F.abs(F.col("unique_count") - F.col("row_count")) <= SKETCH_SIGMAS * SKETCH_RSD * F.col("row_count")
        unique = F.when((F.col("row_count") > 0) & (F.col("null_count") == 0) & near, F.lit(None)).otherwise(F.lit(False))
    else:
        if counts is None:
            typed, slot_names = typed_counts(df, groupable)
            known = typed.groupBy("column_name").agg(F.count_if(~_value_is_null(slot_names)).alias("unique_count"))
        else:
            is_value = F.col("value").isNotNull() & (F.col("count") > 0)
            known = counts.groupBy("column_name").agg(F.count_if(is_value).alias("unique_count"))
        # one row per column on both sides: a tiny join whatever the table size
        stats = stats.join(F.broadcast(known), "column_name", "left").withColumn(
            "unique_count", F.when(F.col("column_name").isin(groupable), F.coalesce("unique_count", F.lit(0)))
        )
        unique = F.coalesce((F.col("unique_count") == F.col("row_count")) & (F.col("row_count") > 0), F.lit(False))
    return stats.withColumn("is_unique_candidate", unique.cast("boolean")).select(
        F.lit(table_name).alias("table_name"), *_stats_columns()
    )


@fixed_expr
def _stats_columns() -> tuple[Column | str, ...]:
    return (
        "position",
        "column_name",
        "data_type",
        "row_count",
        "null_count",
        ratio4("null_count", "row_count").alias("null_rate"),
        F.col("unique_count").cast("long").alias("unique_count"),
        "is_unique_candidate",
        "min_value",
        "max_value",
    )


def unique_count(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """P4 + P5: column_name, row_count, unique_count (NULL excluded), is_unique_candidate.

    A projection of :func:`column_stats`: Catalyst drops the min/max
    aggregates nobody reads, so only the distinct counting runs.
    """
    return column_stats(df, columns=columns, approx=approx).select("column_name", "row_count", "unique_count", "is_unique_candidate")


def min_max(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, min_value, max_value: typed MIN/MAX rendered as text, one wide pass (no value shuffle)."""
    fields = _fields(df, columns)
    return _wide_stats(df, fields, False).select("column_name", "min_value", "max_value")


def top_values(
    df: DataFrame, k: int = 5, table_name: str = "", columns: list[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """P7 + P13: the ``k`` most frequent values per column with their share.

    NULL is a group. Ties break on the value (NULL last) so results repeat.
    Columns: table_name, column_name, rank, value, count, frequency.
    """
    vc = counts if counts is not None else value_counts(df, columns)
    w = Window.partitionBy("column_name").orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    ranked = vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # rows per column = sum of its group counts; one row per column, so the join is tiny
    totals = vc.groupBy("column_name").agg(F.sum("count").alias("__n"))
    return ranked.join(F.broadcast(totals), "column_name").select(
        F.lit(table_name).alias("table_name"),
        "column_name",
        F.col("rank").cast("int").alias("rank"),
        "value",
        "count",
        ratio4("count", "__n").alias("frequency"),
    )


def sample_values(
    df: DataFrame, k: int = 5, table_name: str = "", columns: list[str] | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """``k`` distinct non-NULL values per column, the smallest by text order."""
    vc = counts if counts is not None else value_counts(df, columns)
    # NULL ranks last and goes after ranking: a filter before it would sink below the counts and split their exchange
    w = Window.partitionBy("column_name").orderBy(F.col("value").asc_nulls_last())
    return (
        vc.withColumn("rank", F.row_number().over(w))
        .filter((F.col("rank") <= k) & F.col("value").isNotNull() & (F.col("count") > 0))  # reads the count: same exchange
        .select(F.lit(table_name).alias("table_name"), "column_name", F.col("rank").cast("int").alias("rank"), "value")
    )


def profile_table(
    df: DataFrame, table_name: str = "", k: int = 5, approx: bool = False, columns: list[str] | None = None
) -> DataFrame:
    """Column stats plus bounded ``top_values`` and ``sample_values`` arrays per column."""
    vc = value_counts(df, columns)
    stats = column_stats(df, table_name, columns, approx, None if approx else vc)
    top = (
        top_values(df, k, table_name, columns, counts=vc)
        .groupBy("column_name")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", "value", "count", "frequency"))),
                lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"), s["frequency"].alias("frequency")),
            ).alias("top_values")
        )
    )
    samples = (
        sample_values(df, k, table_name, columns, counts=vc)
        .groupBy("column_name")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values"))
    )
    return (
        stats.join(F.broadcast(top), "column_name", "left")
        .join(F.broadcast(samples), "column_name", "left")
        .repartition(1)  # one row per column: a local sort, no range sampling job
        .sortWithinPartitions("position")
    )


CATALOG_SCHEMA = "table_name string, row_count long, column_count int"


def profile_catalog(tables: dict[str, DataFrame | None], max_tables: int = 0) -> DataFrame:
    """P10: one row per table (rows, columns) in name order; ``max_tables`` caps the list (0 = all).

    A table that cannot be analysed or read (None, or its files do not open) gets ``row_count = -1`` and adds
    nothing to totals. Counting is one small job per table, so that a damaged table fails alone. No tables give no rows.
    """
    spark = SparkSession.active()
    names = sorted(tables)
    if max_tables:
        names = names[:max_tables]

    def one(name: str) -> tuple:
        try:
            return name, tables[name].count(), len(tables[name].columns)
        except Exception as e:  # unreadable source: mark it, keep going
            log.warning("table %s cannot be read: %s", name, e)
            return name, -1, 0

    return spark.createDataFrame(run_per_table(names, one), CATALOG_SCHEMA)


def catalog_summary(catalog: DataFrame, left_out: int = 0) -> DataFrame:
    """Totals of a :func:`profile_catalog` frame: tables, rows (readable only), columns, and how many tables a cap left out."""
    return catalog.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum(F.when(F.col("row_count") >= 0, F.col("row_count"))), F.lit(0)).cast("long").alias("total_rows"),
        F.coalesce(F.sum("column_count"), F.lit(0)).cast("long").alias("total_columns"),
        F.lit(left_out).cast("long").alias("tables_left_out"),
    )


def key_candidates(df: DataFrame, composites: list[list[str]] | None = None, table_name: str = "") -> DataFrame:
    """Which columns, or given column sets, identify a row.

    Columns: table_name, key_columns, row_count, null_rows, distinct_keys,
    surplus_rows (rows beyond one per key), is_key. Single columns come from
    the column stats; each composite is one ``groupBy(keys)`` with partial
    aggregation, so hot keys are pre-aggregated map-side.
    """
    stats = column_stats(df, table_name).filter(F.col("unique_count").isNotNull())
    singles = stats.select(
        "table_name",
        F.col("column_name").alias("key_columns"),
        "row_count",
        F.col("null_count").alias("null_rows"),
        F.col("unique_count").alias("distinct_keys"),
    )
    out = singles
    for keys in composites or []:
        cols = [F.col(f"`{k}`") for k in keys]
        any_null = F.greatest(*[c.isNull().cast("int") for c in cols]) if len(cols) > 1 else cols[0].isNull().cast("int")
        per_key = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.max(any_null).alias("has_null"))
        comp = per_key.agg(
            F.sum("n").cast("long").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("has_null") == 1, F.col("n"))), F.lit(0)).cast("long").alias("null_rows"),
            F.count_if(F.col("has_null") == 0).cast("long").alias("distinct_keys"),
        ).select(F.lit(table_name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*")
        out = out.unionByName(comp)
    return out.select(
        "*",
        (F.col("row_count") - F.col("null_rows") - F.col("distinct_keys")).alias("surplus_rows"),
        ((F.col("null_rows") == 0) & (F.col("distinct_keys") == F.col("row_count")) & (F.col("row_count") > 0)).alias(
            "is_key"
        ),
    )
