"""Federated access (S2): make source tables queryable in place, without copying.

A source is a dict of reader options:

* folder source: ``{"id": "crm", "format": "parquet", "path": "/data/crm"}``; each
  ``<name>.<format>`` entry (file or folder) under ``path`` is a table; CSV tables may declare their columns as
  ``"schemas": {"orders": "id long, day date"}``;
* JDBC source: ``{"id": "his", "format": "jdbc", "url": ..., "driver": ...,
  "user": ..., "password": ...}``; credentials are passed at call time and
  never stored. Partitioned reads take ``partitionColumn``/``lowerBound``/
  ``upperBound``/``numPartitions`` per table through ``table_options``; with the column alone (a number, text, date or time),
  the table is cut into parts of about equal size (:func:`equi_depth_predicates`), by default as many as the cluster's parallelism.

Attached tables are temp views; Catalyst pushes filters, projections, limits
and aggregates into the JDBC query or the parquet scan.
"""

from __future__ import annotations

import datetime as dt
import decimal
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# --- fixed values: schemas that hold no user tables --------------------------
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys", "SYS", "SYSIBM",
                  "SYSCAT", "SYSCS_DIAG", "SYSCS_UTIL", "SYSFUN", "SYSPROC", "SYSSTAT", "NULLID", "SQLJ")
# --- end of fixed values ------------------------------------------------------

_JDBC_KEYS = ("url", "driver", "user", "password", "fetchsize", "sessionInitStatement", "queryTimeout")


def _jdbc_reader(spark: SparkSession, source: dict, extra: dict | None = None):
    r = spark.read.format("jdbc")
    for k in _JDBC_KEYS:
        if source.get(k) is not None:
            r = r.option(k, str(source[k]))
    for k, v in (extra or {}).items():
        r = r.option(k, str(v))
    return r


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark reaches."""
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of files this library has written."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def short_names(tables: list[str]) -> dict[str, str]:
    """Table -> its name without the schema, or with it where two schemas hold a table of that name."""
    last = [t.split(".")[-1].lower() for t in tables]
    return {t: t if last.count(t.split(".")[-1].lower()) > 1 else t.split(".")[-1] for t in tables}


def list_source_tables(spark: SparkSession, source: dict) -> list[str]:
    """Table names of a source (S5 for sources): folder entries or JDBC catalog rows."""
    fmt = source.get("format", "parquet")
    if fmt == "jdbc":
        if source["url"].startswith("jdbc:derby"):
            q = ("SELECT s.SCHEMANAME AS table_schema, t.TABLENAME AS table_name FROM SYS.SYSTABLES t "
                 "JOIN SYS.SYSSCHEMAS s ON t.SCHEMAID = s.SCHEMAID WHERE t.TABLETYPE = 'T'")
        else:
            q = ("SELECT table_schema, table_name FROM information_schema.tables "
                 "WHERE table_type IN ('BASE TABLE', 'TABLE')")
        rows = _jdbc_reader(spark, source, {"query": q}).load()
        schema_col, table_col = rows.columns[:2]  # some databases return upper-case names
        rows = rows.filter(~rows[schema_col].isin(list(SYSTEM_SCHEMAS)))
        # a catalog listing: one row per table, small by nature
        return sorted({f"{r[0]}.{r[1]}" for r in rows.collect()})
    suffix = f".{fmt}"
    names = list_folder(spark, source["path"])
    return sorted({n[: -len(suffix)] for n in names if n.endswith(suffix) and not n.startswith(("_", "."))})


#: Databases that cut a column into groups of equal size themselves; of others a sample of the column is read.
NTILE_DATABASES = ("postgresql", "mysql", "mariadb", "h2", "sqlserver", "oracle")
#: Rows of the sample that cut points come from.
CUT_SAMPLE = 20_000


def _literal(value: object) -> str:
    """A value as SQL text that every JDBC driver understands."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"cannot divide a table by {value!r}")
    if isinstance(value, dt.datetime):
        return f"{{ts '{value:%Y-%m-%d %H:%M:%S.%f}'}}"
    if isinstance(value, dt.date):
        return f"{{d '{value:%Y-%m-%d}'}}"
    if isinstance(value, (int, float, decimal.Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def cut_points(spark: SparkSession, source: dict, table: str, column: str, parts: int) -> list:
    """Ascending values of ``column`` (numbers, text, dates, times) that divide the table's rows into about ``parts`` equal groups.

    Fewer where one value fills more than a group. The database cuts the column where it can; else a sample (:data:`CUT_SAMPLE`
    rows, chosen in one pass over the column alone) gives the values. The database has the last word on their order.
    """
    if source["url"].split(":")[1] in NTILE_DATABASES:
        query = (f"SELECT MIN(k) AS k FROM (SELECT {column} AS k, NTILE({parts}) OVER (ORDER BY {column}) AS part "
                 f"FROM {table} WHERE {column} IS NOT NULL) t GROUP BY part")
        found = {r[0] for r in _jdbc_reader(spark, source, {"query": query}).load().collect()}  # a row per part
    else:
        keys = _jdbc_reader(spark, source, {"query": f"SELECT {column} AS k FROM {table} WHERE {column} IS NOT NULL"}).load().toDF("k")
        sample = keys.withColumn("r", F.rand(7)).orderBy("r").limit(CUT_SAMPLE).orderBy("k")
        values = [r[0] for r in sample.collect()]  # bounded
        found = {values[len(values) * i // parts] for i in range(1, parts)} if values else set()
    if not found:
        return []
    listed = ", ".join(_literal(v) for v in found)
    rows = _jdbc_reader(spark, source, {"query": f"SELECT DISTINCT {column} AS k FROM {table} WHERE {column} IN ({listed})"}).load().toDF("k").collect()
    order = {}
    for v in (r[0] for r in rows):  # how many of the cut points lie below: the database's own order, a few short queries
        below = f"SELECT COUNT(DISTINCT {column}) AS n FROM {table} WHERE {column} IN ({listed}) AND {column} < {_literal(v)}"
        order[v] = _jdbc_reader(spark, source, {"query": below}).load().first()[0]
    return sorted(order, key=order.get)


def equi_depth_predicates(spark: SparkSession, source: dict, table: str, column: str, parts: int) -> list[str]:
    """Conditions that divide a JDBC table into about equal parts; every row, also one without a key, meets exactly one."""
    cuts = [_literal(v) for v in cut_points(spark, source, table, column, parts)]
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def read_source_table(spark: SparkSession, source: dict, table: str, table_options: dict | None = None) -> DataFrame:
    fmt = source.get("format", "parquet")
    options = dict(table_options or {})
    if fmt == "jdbc":
        if options.get("partitionColumn") and not {"lowerBound", "upperBound"} <= set(options):
            column = options.pop("partitionColumn")
            parts = int(options.pop("numPartitions", spark.sparkContext.defaultParallelism))
            predicates = equi_depth_predicates(spark, source, table, column, parts)
            properties = {k: str(source[k]) for k in _JDBC_KEYS if k != "url" and source.get(k) is not None}
            return spark.read.jdbc(source["url"], table, predicates=predicates, properties=properties | {k: str(v) for k, v in options.items()})
        return _jdbc_reader(spark, source, {"dbtable": table, **options}).load()
    reader = spark.read.format(fmt)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    if fmt == "csv":
        reader = reader.option("header", True)
        declared = source.get("schemas", {}).get(table)
        # without a declared schema, types are found by reading every file once more
        reader = reader.schema(declared) if declared else reader.option("inferSchema", True)
    return reader.load(f"{source['path'].rstrip('/')}/{table}.{fmt}")


def attach_source(
    spark: SparkSession, source: dict, tables: list[str] | None = None, table_options: dict[str, dict] | None = None
) -> list[str]:
    """Register each table as temp view ``<id>_<table>``; return sorted view names.

    Tables of one name in two schemas become ``<id>_<schema>_<table>``. A table that fails to resolve is
    skipped with a warning; the others attach.
    """
    from kiln.sources.tables import view_name

    names = tables if tables is not None else list_source_tables(spark, source)
    short = short_names(names)
    attached = set()
    for t in names:
        try:
            df = read_source_table(spark, source, t, (table_options or {}).get(t))
            df.schema  # resolve now: a missing table fails here, not later
        except Exception as e:  # keep going, as the reference does
            log.warning("skip %s.%s: %s", source.get("id"), t, e)
            continue
        v = view_name("src", source.get("id", "src"), short[t])
        df.createOrReplaceTempView(v)
        attached.add(v)
    return sorted(attached)
