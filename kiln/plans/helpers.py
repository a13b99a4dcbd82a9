"""Plan-time helpers.

They decide *what* the operators do from names, specs and catalogs (tens to
hundreds of rows), so each is plain driver code or a tiny DataFrame job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.plans.spec import Mapping, QCRules, Standard

SYSTEM_DATABASES = ("information_schema", "sys", "global_temp")


def list_tables(spark: SparkSession, db: str | None = None, max_tables: int = 0, base_only: bool = False) -> list[str]:
    """Tables of a database (or all user databases), sorted; ``max_tables`` caps (0 = all).

    ``base_only`` drops views and temporary views (the delivery variant).
    """
    dbs = [db] if db else [d.name for d in spark.catalog.listDatabases() if d.name not in SYSTEM_DATABASES]
    names = []
    for d in dbs:
        for t in spark.catalog.listTables(d):
            if t.isTemporary and db:
                continue
            if base_only and (t.tableType == "VIEW" or t.isTemporary):
                continue
            names.append(f"{d}.{t.name}" if not db else t.name)
    names = sorted(set(names))
    return names[:max_tables] if max_tables else names


def used_sources(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """The source tables a project needs, per source, sorted.

    ``mappings``: (target_table, target_field, kind, source_table); ``catalog``:
    (source_id, source_order, table_name). A table named by a mapping (last
    dotted part, case-insensitive) belongs to the first listed source that
    holds it; tables no source holds are dropped.
    """
    wanted = (
        mappings.filter((F.col("kind") != "missing") & F.col("source_table").isNotNull())
        .select(F.lower(F.element_at(F.split("source_table", r"\."), -1)).alias("table_name"))
        .distinct()
    )
    holders = catalog.select("source_id", "source_order", F.lower("table_name").alias("table_name"))
    first = Window.partitionBy("table_name").orderBy("source_order")
    owned = wanted.join(holders, "table_name").withColumn("rk", F.row_number().over(first)).filter("rk = 1")
    return owned.groupBy("source_id").agg(F.sort_array(F.collect_set("table_name")).alias("tables")).orderBy("source_id")


def column_metadata(df: DataFrame, table_name: str = "") -> DataFrame:
    """Name, type, nullable, max length, precision, scale, comment per column (from the schema)."""
    rows = []
    for i, f in enumerate(df.schema.fields):
        prec = f.dataType.precision if isinstance(f.dataType, T.DecimalType) else None
        scale = f.dataType.scale if isinstance(f.dataType, T.DecimalType) else None
        length = f.dataType.length if isinstance(f.dataType, (T.VarcharType, T.CharType)) else None
        rows.append((table_name, i, f.name, f.dataType.simpleString(), f.nullable, length, prec, scale, f.metadata.get("comment")))
    schema = (
        "table_name string, position int, column_name string, data_type string, nullable boolean, "
        "max_length int, precision int, scale int, comment string"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def focus_profile(profile: DataFrame, tables: Sequence[str] | None = None, full: bool = True) -> DataFrame:
    """Restrict a profile to named tables; basic (type, nullability) or full statistics."""
    out = profile.filter(F.col("table_name").isin(list(tables))) if tables else profile
    if full:
        return out
    keep = [c for c in ("table_name", "position", "column_name", "data_type", "nullable") if c in out.columns]
    return out.select(*keep)


def check_mappings(mappings: DataFrame, catalog: DataFrame) -> DataFrame:
    """T5: numbered errors for mappings whose table or field no profiled source holds.

    ``mappings``: (target_field, kind, source_table, source_field); ``catalog``:
    (source_id, source_order, table_name, column_name). The field must be in
    the table of the *first* source that holds the table.
    """
    m = mappings.filter(
        (F.col("kind") != "missing") & F.col("source_table").isNotNull() & F.col("source_field").isNotNull()
    ).withColumn("table_name", F.element_at(F.split("source_table", r"\."), -1))
    tables = catalog.select("source_id", "source_order", "table_name").distinct()
    first = Window.partitionBy("table_name").orderBy("source_order")
    owner = tables.withColumn("rk", F.row_number().over(first)).filter("rk = 1").drop("rk")
    no_table = m.join(owner, "table_name", "left_anti").select(
        "target_field", F.concat(F.lit("table not found in any source: "), F.col("source_table")).alias("error")
    )
    cols = catalog.select("source_id", "table_name", F.col("column_name").alias("source_field"))
    with_owner = m.join(owner, "table_name")
    no_field = with_owner.join(cols, ["source_id", "table_name", "source_field"], "left_anti").select(
        "target_field",
        F.concat(F.lit("field not found: "), F.col("source_table"), F.lit("."), F.col("source_field")).alias("error"),
    )
    errors = no_table.unionByName(no_field)
    # numbering needs one ordered pass; errors are bounded by the mapping count (hundreds at most)
    return errors.withColumn("n", F.row_number().over(Window.orderBy("target_field", "error")))


def filter_confidence(mappings: Sequence[Mapping], minimum: float) -> list[Mapping]:
    """Keep mappings with confidence >= minimum (derived mappings carry a real confidence)."""
    return [m for m in mappings if m.confidence >= minimum]


def primary_source(mappings: Sequence[Mapping]) -> str | None:
    """M5: the source table with most direct/transform mappings; ties go to the first seen."""
    counts: dict[str, int] = {}
    for m in mappings:
        if m.kind in ("direct", "transform") and m.source_table:
            counts[m.source_table] = counts.get(m.source_table, 0) + 1
    if not counts:
        return None
    best = max(counts.values())
    return next(t for t in counts if counts[t] == best)


def rules_from_standard(standard: Standard) -> QCRules:
    """Q1: not-null checks for NOT NULL fields, unique checks for fields constrained ``unique``."""
    return QCRules(
        standard.table,
        tuple(f.name for f in standard.fields if not f.nullable),
        tuple(f.name for f in standard.fields if any("unique" in c.lower() for c in f.constraints)),
    )


def qc_gate(report: DataFrame) -> bool:
    """Q6: delivery is allowed only when every check passed (one boolean from an aggregate)."""
    ok = report.agg(F.coalesce(F.bool_and(F.col("status") == "pass"), F.lit(False)).alias("ok")).first()
    return bool(ok["ok"])


def require_gate(report: DataFrame) -> None:
    """Q6 as a guard before delivery: raise with the failing checks."""
    if not qc_gate(report):
        bad = [r.check_name for r in report.filter("status <> 'pass'").select("check_name").collect()]  # one name per check
        raise RuntimeError(f"quality gate closed; failing checks: {bad}")
