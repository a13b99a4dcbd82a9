"""Source exploration: list a source's tables, profile every column, find and mask personal data.

The flow of a source explore as Spark jobs: a catalog of row and column
counts (P10), column statistics per table (P1-P6), a PII scan per table (I5), and the profile of sensitive
columns masked (I11) so no value shows in clear. Everything is one lazy
plan: scan results are joined, not collected, so Spark schedules all tables'
stages together and nothing but the final report reaches the driver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from kiln.operators.pii import mask_profile, pii_scan
from kiln.operators.profile import catalog_summary, column_stats, groupable_columns, profile_catalog, value_counts
from kiln.sources.attach import list_source_tables, read_source_table

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class ExploreReport:
    catalog: DataFrame  # table_name, row_count, column_count
    columns: DataFrame  # column stats (+ detected_by, pii_types when masking)
    summary: DataFrame  # total_tables, total_rows, total_columns


def explore(
    spark: SparkSession,
    source: dict,
    tables: list[str] | None = None,
    max_tables: int = 0,
    mask_sensitive: bool = True,
    threshold: float = 0.3,
    approx: bool = False,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> ExploreReport:
    """Profile a source: named tables (else all it lists, sorted), capped at ``max_tables`` (0 = all).

    ``prepare`` is applied to each table before profiling (e.g. type casts). A table that cannot be
    listed, opened or read is a catalog row with -1 rows and has no column rows; the others go on. The summary
    says how many tables ``max_tables`` left out.
    """
    names = sorted(tables) if tables is not None else list_source_tables(spark, source)
    left_out = max(len(names) - max_tables, 0) if max_tables else 0
    if max_tables:
        names = names[:max_tables]
    frames: dict[str, DataFrame | None] = {}
    for t in names:
        try:
            df = read_source_table(spark, source, t)
            frames[t] = prepare(df) if prepare else df
        except Exception as e:  # reported in the catalog
            log.warning("table %s cannot be opened: %s", t, e)
            frames[t] = None
    catalog = profile_catalog(frames)
    readable = {r["table_name"] for r in catalog.where("row_count >= 0").collect()}  # table names only
    parts = []
    for t in names:
        if t not in readable:
            continue
        counts = value_counts(frames[t]) if groupable_columns(frames[t]) and not approx else None  # shared by both
        stats = column_stats(frames[t], t, approx=approx, counts=counts)
        if mask_sensitive:
            scan = pii_scan(frames[t], threshold, counts=counts)  # one row per column, joined lazily
            stats = mask_profile(stats, scan, keep=("detected_by", "pii_types"))
        parts.append(stats)
    if parts:
        columns = reduce(DataFrame.unionByName, parts)
    else:
        empty = spark.createDataFrame([], "none int")
        columns = column_stats(empty, "").limit(0)
    return ExploreReport(catalog, columns, catalog_summary(catalog, left_out))
