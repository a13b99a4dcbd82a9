"""Staging sync (S3), bulk copy (S4) and table writes.

Tables land in catalog databases whose location is under the shared folder
(``spark.checkpoint.dir``), never a machine-local temp path. Row counts come
from an ``Observation`` on the write itself, not a second scan.
"""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.session import shared_dir
from kiln.sources.publish import (
    GRACE,
    attempt_path,
    can_swap_tables,
    drop_jdbc_table,
    new_attempt,
    pointer_kind,
    restore_folder,
    suffixed,
    swap_folder,
    swap_tables,
    switch_location,
)

log = logging.getLogger(__name__)

RESULT_SCHEMA = "source_id string, table_name string, target string, status string, rows_copied long, message string"


def ensure_database(spark: SparkSession, db: str) -> str:
    """``CREATE DATABASE IF NOT EXISTS`` located in the shared folder."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", db):
        raise ValueError(f"bad database name: {db}")
    loc = shared_dir(spark, "warehouse", f"{db}.db")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{loc}'")
    return db


def all_nullable(df: DataFrame) -> DataFrame:
    """Same columns, every field nullable (staging and cross-database copies)."""

    def loosen(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(f.name, loosen(f.dataType), True) for f in t.fields])
        if isinstance(t, T.ArrayType):
            return T.ArrayType(loosen(t.elementType), True)
        if isinstance(t, T.MapType):
            return T.MapType(t.keyType, loosen(t.valueType), True)
        return t

    return df.to(loosen(df.schema))


def write_table(
    df: DataFrame,
    db: str,
    name: str,
    partition_by: list[str] | None = None,
    mode: str = "overwrite",
    managed: bool = False,
    grace: float = GRACE,
) -> int:
    """Materialise as a catalog table; returns rows written (observed during the write).

    An overwrite writes a folder of its own under the database folder and points the table at it when it is
    complete (:mod:`kiln.sources.publish`): a failed one leaves the old rows as they are, and a reader of the old
    rows can finish. Other modes write into the table's folder. ``managed=True`` keeps the catalog owner of the
    files (dropping deletes them); use it only for names that are never reused.
    """
    spark = df.sparkSession
    ensure_database(spark, db)
    obs = Observation(f"rows_{db}_{name}_{uuid.uuid4().hex[:8]}")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if managed:
        w.mode(mode).saveAsTable(f"{db}.{name}")
    elif mode == "overwrite":
        base, attempt = shared_dir(spark, "warehouse", f"{db}.db"), new_attempt(name)
        w.save(f"{base}/{attempt}")
        switch_location(spark, db, name, base, attempt, partition_by, grace)
    elif pointer_kind(spark, db, name):
        w.mode(mode).saveAsTable(f"{db}.{name}")
    else:
        w.mode(mode).option("path", shared_dir(spark, "warehouse", f"{db}.db", new_attempt(name))).saveAsTable(f"{db}.{name}")
    return int(obs.get["rows"])


def bulk_copy(
    df: DataFrame, target: dict, batch_size: int = 10000, mode: str = "overwrite", loosen: bool = True, grace: float = GRACE
) -> int:
    """Copy rows to a path/format or a JDBC table; returns rows copied.

    An overwrite copies to a folder or table beside the target, which takes the target's name when it is
    complete: a failed copy leaves the old rows readable and never duplicates any. Over JDBC this takes a database whose
    way of renaming tables is known (:data:`kiln.sources.publish.RENAMES`); others are overwritten in place by Spark, with a
    warning. JDBC writes go in batches of ``batch_size`` per task (``batchsize``), over at most ``numPartitions``
    connections. ``loosen`` makes all columns nullable.
    """
    spark = df.sparkSession
    obs = Observation(f"bulk_copy_{uuid.uuid4().hex[:8]}")
    out = (all_nullable(df) if loosen else df).observe(obs, F.count(F.lit(1)).alias("rows"))
    fmt = target.get("format", "parquet")
    if fmt == "jdbc":
        swap = mode == "overwrite" and can_swap_tables(target["url"])
        if mode == "overwrite" and not swap:
            log.warning("overwriting %s in place: no known way to rename its tables", target["dbtable"])
        table = suffixed(target["dbtable"], f"_{uuid.uuid4().hex[:8]}") if swap else target["dbtable"]
        w = out.write.format("jdbc").mode(mode).option("batchsize", str(batch_size)).option("dbtable", table)
        for k in ("url", "driver", "user", "password", "isolationLevel", "numPartitions"):
            if target.get(k) is not None:
                w = w.option(k, str(target[k]))
        if not swap and target.get("truncate") is not None:
            w = w.option("truncate", str(target["truncate"]))
        try:
            w.save()
            if swap:
                swap_tables(spark, target, table)
        except BaseException:
            if swap:
                drop_jdbc_table(spark, target, table)
            raise
    elif mode == "overwrite":
        restore_folder(spark, target["path"])
        attempt = attempt_path(target["path"])
        out.write.format(fmt).save(attempt)
        swap_folder(spark, attempt, target["path"], grace)
    else:
        out.write.format(fmt).mode(mode).save(target["path"])
    return int(obs.get["rows"])


def ods_name(source_id: str) -> str:
    return "ods_" + re.sub(r"[^0-9a-z_]", "_", source_id.lower())


def sync_to_ods(
    spark: SparkSession,
    source_id: str,
    tables: dict[str, DataFrame | None],
    ods: str | None = None,
    max_parallel: int = 4,
) -> DataFrame:
    """S3: full-refresh copy of each table into ``ods_<source>``; one result row per table.

    ``None`` for a table means it is absent at the source: ``skipped``. A failing
    table is ``failed`` and the others still run; success reports rows copied.
    """
    db = ensure_database(spark, ods or ods_name(source_id))

    def one(name: str) -> tuple:
        df = tables[name]
        target = f"{db}.{re.sub(r'[^0-9a-z_]', '_', name.lower())}"
        if df is None:
            return (source_id, name, target, "skipped", None, "absent at source")
        try:
            n = write_table(all_nullable(df), db, target.partition(".")[2])
            return (source_id, name, target, "success", n, "")
        except Exception as e:  # per-table failure does not stop the sync
            return (source_id, name, target, "failed", None, str(e))

    results = run_per_table(sorted(tables), one, max_parallel)
    return spark.createDataFrame(results, RESULT_SCHEMA)


def run_per_table(names: list[str], fn, max_parallel: int = 4) -> list:
    """Run one Spark job per table from a few driver threads (Spark schedules them side by side).

    Results come back in ``names`` order; each table's data still moves as one
    distributed job.
    """
    if max_parallel <= 1 or len(names) <= 1:
        return [fn(n) for n in names]
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max_parallel) as pool:
        return list(pool.map(fn, names))


def sync_source(
    spark: SparkSession,
    source: dict,
    tables: list[str] | None = None,
    ods: str | None = None,
    table_options: dict[str, dict] | None = None,
) -> DataFrame:
    """S3 from a source description: the named tables, or every table the source lists.

    Tables are named without their schema where that is unambiguous, else ``schema.table`` (staged as
    ``schema_table``). ``table_options`` gives reader options by table, for example ``{"orders": {"partitionColumn": "id"}}``
    for a JDBC read in several tasks (bounds and count are found when left out). A named table the
    source lacks is ``skipped``; an ambiguous or failing one is ``failed`` and the rest continue.
    """
    from kiln.sources.attach import list_source_tables, read_source_table, short_names

    present = list_source_tables(spark, source)
    short = short_names(present)
    by_name = {t.lower(): t for t in present} | {s.lower(): t for t, s in short.items()}
    by_last: dict[str, list[str]] = {}
    for t in present:
        by_last.setdefault(t.split(".")[-1].lower(), []).append(t)
    frames: dict[str, DataFrame | None] = {}
    failed = []
    for name in tables if tables is not None else list(short.values()):
        real = by_name.get(name.lower())
        if real is None and "." not in name and len(by_last.get(name.lower(), [])) > 1:
            failed.append((source.get("id", "src"), name, "", "failed", None, f"in several schemas: {by_last[name.lower()]}"))
            continue
        real = real or next(iter(by_last.get(name.split(".")[-1].lower(), [])), None)
        options = (table_options or {}).get(name) or (table_options or {}).get(real or "")
        try:
            frames[name] = read_source_table(spark, source, real, options) if real else None
        except Exception as e:  # reported as a row
            failed.append((source.get("id", "src"), name, "", "failed", None, str(e)))
    done = sync_to_ods(spark, source.get("id", "src"), frames, ods)
    return done.unionByName(spark.createDataFrame(failed, RESULT_SCHEMA)) if failed else done
