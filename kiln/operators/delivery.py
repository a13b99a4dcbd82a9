"""Delivery (D2-D7): replace, atomic switch, copy; per-table results, summary, run history.

The per-table loop runs on the driver over table *names* (a project has tens of
tables); each table's data moves as one distributed write.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.plans.names import prod_name
from kiln.sources.attach import read_source_table
from kiln.sources.ods import bulk_copy, ensure_database, run_per_table, write_table
from kiln.sources.publish import GRACE, attempt_path, folder_exists, new_attempt, restore_folder, swap_folder, switch_view

RESULT_SCHEMA = "clean_table string, prod_table string, strategy string, status string, rows long, message string"
STRATEGIES = ("atomic", "replace", "copy")


def deliver_replace(df: DataFrame, db: str, name: str, grace: float = GRACE) -> int:
    """Replace the prod table by one with the clean data.

    The data is written to a folder of its own, and the table is pointed at it when it is complete
    (:func:`kiln.sources.publish.switch_location`). A failed write leaves the old table as it is. The version before stays for
    one cycle, so that a reader of it can finish, whatever other attempts have left behind.
    """
    return write_table(df, db, name, grace=grace)


def deliver_atomic(df: DataFrame, db: str, name: str, grace: float = GRACE) -> int:
    """D3: build a new version, then switch readers to it in one catalog operation.

    ``<name>__v<ms>`` is written in full first; ``CREATE OR REPLACE VIEW <name>``
    then points at it (a single metadata change). Readers see the old or the new version, never a mix, and
    the version before, which the view's own definition names, stays for one cycle, so that a reader of it can
    finish. Versions that were never published go after ``grace`` seconds; another delivery may be writing a younger one.
    """
    spark = df.sparkSession
    ensure_database(spark, db)
    version = new_attempt(name)
    rows = write_table(df, db, version, managed=True)  # unique name: dropping it frees its files
    switch_view(spark, db, name, version, grace)
    return rows


def deliver_copy(df: DataFrame, target: dict) -> int:
    """Copy to another store (path + format, or JDBC); all columns nullable; a failed copy leaves the old rows."""
    return bulk_copy(df, target)


def choose_strategy(target: dict | None) -> str:
    """The atomic switch on this platform's own catalog, a copy where the target is another database or folder."""
    return "atomic" if target is None else "copy"


def copy_target(target: dict, name: str) -> dict:
    """Where a table goes: a folder under ``path``, or a table of the JDBC target (in its ``schema``, if it names one)."""
    if target.get("format") == "jdbc":
        return {**target, "dbtable": f"{target['schema']}.{name}" if target.get("schema") else name}
    return {"format": target.get("format", "parquet"), "path": f"{target['path'].rstrip('/')}/{name}"}


def _read_back(spark: SparkSession, target: dict) -> DataFrame:
    if target.get("format") == "jdbc":
        return read_source_table(spark, target, target["dbtable"])
    return spark.read.format(target["format"]).load(target["path"])


def deliver(
    spark: SparkSession,
    tables: dict[str, DataFrame | str] | str,
    strategy: str = "auto",
    prod_db: str = "prod",
    copy_root: str | None = None,
    dry_run: bool = False,
    max_parallel: int = 4,
    target: dict | None = None,
) -> DataFrame:
    """Deliver clean tables to prod; one result row per table.

    Without a strategy the target decides (:func:`choose_strategy`): none is this platform's database ``prod_db``, else
    ``target`` is a folder (``path``, ``format``) or another database (``format`` jdbc, ``url``, ``driver``, ``user``,
    ``password``, ``schema``), to which the tables are copied. ``copy_root`` is short for a parquet folder.
    ``tables`` maps clean table names to DataFrames or catalog names. The prod
    name drops a leading ``clean_``. An unknown strategy gives an error row per
    table; a failing table does not stop the others. Delivered row counts are
    re-read from the prod table (D6), not trusted from the write. A database
    name instead of a dict delivers all base tables of that database.
    """
    if isinstance(tables, str):
        from kiln.plans.helpers import list_tables

        tables = {t: f"{tables}.{t}" for t in list_tables(spark, tables, base_only=True)}
    other = target or ({"path": copy_root} if copy_root else None)
    strategy = choose_strategy(other) if strategy == "auto" else strategy

    def one(clean: str) -> tuple:
        target = prod_name(clean)
        if strategy not in STRATEGIES:
            return (clean, target, strategy, "error", None, f"unknown strategy: {strategy}")
        if strategy == "copy" and other is None:
            return (clean, target, strategy, "error", None, "a copy needs a target")
        if dry_run:
            to = copy_target(other, target) if strategy == "copy" else {}
            return (clean, target, strategy, "planned", None, f"{clean} -> {to.get('dbtable') or to.get('path') or f'{prod_db}.{target}'}")
        try:
            src = tables[clean]
            df = spark.table(src) if isinstance(src, str) else src
            if strategy == "replace":
                deliver_replace(df, prod_db, target)
                rows = spark.table(f"{prod_db}.{target}").count()
            elif strategy == "atomic":
                deliver_atomic(df, prod_db, target)
                rows = spark.table(f"{prod_db}.{target}").count()
            else:
                to = copy_target(other, target)
                deliver_copy(df, to)
                rows = _read_back(spark, to).count()
            return (clean, target, strategy, "success", rows, "")
        except Exception as e:  # keep delivering the others
            return (clean, target, strategy, "failed", None, str(e))

    if not dry_run and strategy in ("replace", "atomic"):
        ensure_database(spark, prod_db)  # once, before the per-table threads
    results = run_per_table(sorted(tables), one, max_parallel)
    return spark.createDataFrame(results, RESULT_SCHEMA)


def delivery_summary(results: DataFrame) -> DataFrame:
    """D6 totals: tables, successes, failures, rows; ``delivered`` only when nothing failed."""
    return results.agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status").isin("failed", "error")).alias("failed"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("total_rows"),
    ).withColumn("status", F.when(F.col("failed") == 0, "delivered").otherwise("partial"))


def append_history(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    run_id: int,
    kind: str,
    operation: str = "",
    target: str = "",
    details: str = "",
    key: str | None = None,
) -> bool:
    """Append one attempt's rows (check results or delivered counts) to the history table.

    ``rows`` needs ``item`` (check or table name) and ``value`` (failures or
    rows); time is UTC, the user is the Spark user. No secrets are written. Nothing is ever replaced: what a rerun
    writes counts instead of its earlier attempt's rows of the same items (:func:`latest_attempts`). With ``key`` (of the job that
    appends) the append can be repeated: rows of that key are not appended twice. Returns whether rows were appended.
    """
    if key is not None and any(key == k for k in _history_keys(spark, path, run_id, kind)):
        return False
    attempt = f"{time.time_ns() // 1_000:020d}_{uuid.uuid4().hex[:6]}"
    attempt = attempt if key is None else f"{attempt}:{key}"
    out = rows.select(
        F.lit(run_id).cast("long").alias("run_id"),
        F.lit(kind).alias("kind"),
        F.col("item").cast("string").alias("item"),
        F.col("value").cast("long").alias("value"),
        F.current_timestamp().alias("recorded_at"),
        F.lit(spark.sparkContext.sparkUser()).alias("recorded_by"),
        F.lit(operation).alias("operation"),
        F.lit(target).alias("target"),
        F.lit(details).alias("details"),
        F.lit(attempt).alias("attempt"),
    )
    out.write.mode("append").partitionBy("run_id", "kind").parquet(path)
    return True


def _history_keys(spark: SparkSession, path: str, run_id: int, kind: str) -> list[str]:
    """Keys of the appends of a run and kind (a few)."""
    folder = f"{path.rstrip('/')}/run_id={run_id}/kind={kind}"
    if not folder_exists(spark, folder):
        return []
    attempts = spark.read.parquet(folder).select("attempt").distinct().collect()
    return [r.attempt.partition(":")[2] for r in attempts if ":" in r.attempt]


def compact_history(spark: SparkSession, path: str, grace: float = GRACE) -> int:
    """Rewrite the history with one file for each run and kind; returns the rows.

    The new files are written beside the old ones and take their place when complete; a failed compaction changes nothing. No
    append may run meanwhile.
    """
    restore_folder(spark, path)
    rows = spark.read.parquet(path)
    attempt = attempt_path(path)
    rows.repartition("run_id", "kind").write.partitionBy("run_id", "kind").parquet(attempt)
    n = spark.read.parquet(attempt).count()
    swap_folder(spark, attempt, path, grace)
    return n


def latest_attempts(history: DataFrame) -> DataFrame:
    """The history with one row per run, kind and item: that of the last attempt that wrote the item."""
    rest = [c for c in history.columns if c not in ("run_id", "kind", "item")]
    last = F.max_by(F.struct(*rest), F.col("attempt")).alias("r")
    return history.groupBy(F.col("run_id").cast("long").alias("run_id"), "kind", "item").agg(last).select("run_id", "kind", "item", "r.*")


def compare_runs(history: DataFrame) -> DataFrame:
    """Every item with the value of its previous run and the change (last attempts only)."""
    w = Window.partitionBy("kind", "item").orderBy("run_id")  # one row per run and item: bounded by run count
    prev = F.lag("value").over(w)
    return latest_attempts(history).select(
        "kind", "item", "run_id", "value", prev.alias("previous_value"), (F.col("value") - prev).alias("change")
    )
