"""Quality checks (Q2-Q5) that really run: every check returns failure counts as rows.

Not-null checks of one table share one aggregate pass; unique checks of one
table share one shuffle (typed long form ``(field, value)`` with partial
aggregation); orphan checks are ``left_anti`` joins. A check that cannot run is a row with status ``error``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators.profile import typed_counts
from kiln.plans.spec import Standard, max_length

CHECK_COLUMNS = ("check_name", "table_name", "check_type", "field", "failures")
CHECK_SCHEMA = "check_name string, table_name string, check_type string, field string, failures long"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def check_not_null(df: DataFrame, fields: Sequence[str], table_name: str = "") -> DataFrame:
    """Q2: rows where each field is NULL, all fields in one pass."""
    wide = df.agg(*[F.count_if(_c(f).isNull()).alias(f"n{i}") for i, f in enumerate(fields)])
    rows = [
        F.struct(
            F.lit(f"not_null_{table_name}_{f}").alias("check_name"),
            F.lit(table_name).alias("table_name"),
            F.lit("not_null").alias("check_type"),
            F.lit(f).alias("field"),
            F.col(f"n{i}").cast("long").alias("failures"),
        )
        for i, f in enumerate(fields)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_unique(df: DataFrame, fields: Sequence[str | Sequence[str]], table_name: str = "") -> DataFrame:
    """Q3: failures = number of values (or key combinations) held by more than one row; NULL ignored.

    Single fields share one shuffle over ``(field, value)``; a composite key is
    its own ``groupBy``. Both pre-aggregate map-side, so hot values cost one
    row per task.
    """
    singles = [f for f in fields if isinstance(f, str)]
    composites = [list(f) for f in fields if not isinstance(f, str)]
    parts = []
    if singles:
        counts, slots = typed_counts(df, singles)
        is_null = reduce(lambda a, b: a & b, [F.col("value")[s].isNull() for s in slots])
        dup = (
            counts.filter((F.col("count") > 1) & ~is_null)
            .groupBy(F.col("column_name").alias("field"))
            .agg(F.count(F.lit(1)).alias("failures"))
        )
        # fields without duplicates must still report 0: add them as zero rows
        zero = df.sparkSession.createDataFrame([(f, 0) for f in singles], "field string, failures long")
        counted = zero.unionByName(dup).groupBy("field").agg(F.sum("failures").cast("long").alias("failures"))
        parts.append(counted)
    for keys in composites:
        cols = [_c(k) for k in keys]
        not_null = cols[0].isNotNull()
        for c in cols[1:]:
            not_null = not_null & c.isNotNull()
        dup = df.filter(not_null).groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        parts.append(dup.agg(F.count(F.lit(1)).cast("long").alias("failures")).select(F.lit(",".join(keys)).alias("field"), "failures"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(
        F.concat(F.lit(f"unique_{table_name}_"), F.regexp_replace("field", ",", "_")).alias("check_name"),
        F.lit(table_name).alias("table_name"),
        F.lit("unique").alias("check_type"),
        "field",
        "failures",
    )


def check_custom(df: DataFrame, name: str, predicate: str | Column, table_name: str = "", field: str = "") -> DataFrame:
    """Q4: rows for which ``predicate`` (what must hold) is false or NULL."""
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    return df.agg(F.count_if(~F.coalesce(pred, F.lit(False))).cast("long").alias("failures")).select(
        F.lit(name).alias("check_name"),
        F.lit(table_name).alias("table_name"),
        F.lit("custom").alias("check_type"),
        F.lit(field).alias("field"),
        "failures",
    )


def check_custom_sql(spark: SparkSession, name: str, sql: str, table_name: str = "", field: str = "") -> DataFrame:
    """Q4, SQL form: failures = rows that ``sql`` (a query for bad rows) returns."""
    return spark.sql(sql).agg(F.count(F.lit(1)).cast("long").alias("failures")).select(
        F.lit(name).alias("check_name"),
        F.lit(table_name).alias("table_name"),
        F.lit("custom").alias("check_type"),
        F.lit(field).alias("field"),
        "failures",
    )


def check_rows(
    df: DataFrame, table_name: str, not_null: Sequence[str] = (), custom: Sequence[tuple[str, str | Column, str]] = ()
) -> DataFrame:
    """Q2 and Q4 together: all not-null checks and custom predicates (name, what must hold, field) of a table in one pass."""
    checks = [(f"not_null_{table_name}_{f}", "not_null", f, _c(f).isNotNull()) for f in not_null]
    for name, predicate, field in custom:
        holds = F.expr(predicate) if isinstance(predicate, str) else predicate
        checks.append((name, "custom", field, F.coalesce(holds, F.lit(False))))
    wide = df.agg(*[F.count_if(~ok).cast("long").alias(f"n{i}") for i, (_, _, _, ok) in enumerate(checks)])
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            F.lit(table_name).alias("table_name"),
            F.lit(kind).alias("check_type"),
            F.lit(field).alias("field"),
            F.col(f"n{i}").alias("failures"),
        )
        for i, (name, kind, field, _) in enumerate(checks)
    ]
    return wide.select(F.inline(F.array(*rows)))


def check_lengths(df: DataFrame, standard: Standard) -> DataFrame:
    """Values longer than the VARCHAR(n) or CHAR(n) of their field, all fields in one pass."""
    limits = [(f.name, max_length(f.data_type)) for f in standard.fields if f.name in df.columns]
    rules = [
        (f"length_{standard.table}_{f}", F.coalesce(F.length(_c(f).cast("string")) <= n, F.lit(True)), f) for f, n in limits if n
    ]
    if not rules:
        return df.sparkSession.createDataFrame([], CHECK_SCHEMA)
    return check_rows(df, standard.table, custom=rules)


@dataclass(frozen=True)
class Check:
    """A check that :func:`run_checks` runs on its own: ``run`` returns a frame of check rows."""

    name: str
    table_name: str
    check_type: str
    field: str
    run: Callable[[], DataFrame]


def run_checks(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    """Run each check by itself; one that fails to run (unknown column, unreadable table) becomes an error row with the whole message.

    The rows collected here are check results: one per checked field.
    """
    rows = []
    for c in checks:
        try:
            rows += [(*r, None) for r in c.run().select(*CHECK_COLUMNS).collect()]
        except Exception as e:  # reported as a row
            rows.append((c.name, c.table_name, c.check_type, c.field, None, str(e)))
    return spark.createDataFrame(rows, CHECK_SCHEMA + ", error string")


def check_references(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, table_name: str = "", parent_name: str = ""
) -> DataFrame:
    """Q4 (relationships): child rows whose non-NULL key has no parent.

    Child keys are counted first (partial aggregation: a key holding a third
    of the rows crosses the shuffle as one row per task), then anti-joined
    with the parent's keys, and the orphan rows summed.
    """
    per_key = child.filter(_c(child_key).isNotNull()).groupBy(_c(child_key).alias("__ck")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(_c(parent_key).alias("__pk"))
    orphans = per_key.join(keys, F.col("__ck") == F.col("__pk"), "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("failures")).select(
        F.lit(f"relationships_{table_name}_{child_key}_{parent_name}").alias("check_name"),
        F.lit(table_name).alias("table_name"),
        F.lit("relationships").alias("check_type"),
        F.lit(child_key).alias("field"),
        "failures",
    )


def qc_report(checks: Sequence[DataFrame]) -> DataFrame:
    """Q5: all check rows with status ``pass`` (0 failures), ``fail`` or ``error`` (could not run, see :func:`run_checks`).

    No checks give an empty report.
    """
    out = SparkSession.active().createDataFrame([], CHECK_SCHEMA + ", error string")
    for c in checks:
        out = out.unionByName(c, allowMissingColumns=True)
    ok = F.col("failures") == 0
    status = F.when(F.col("error").isNotNull(), "error").when(ok, "pass").otherwise("fail")
    failing = F.concat(F.col("failures").cast("string"), F.lit(" failing"))
    msg = F.when(F.col("error").isNotNull(), F.col("error")).when(ok, F.lit("ok")).otherwise(failing)
    return out.withColumn("status", status).withColumn("message", msg).drop("error")


def qc_totals(report: DataFrame) -> DataFrame:
    """Totals by status: passed, failed, errors, and whether the gate is open (Q6)."""
    return report.agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "error").alias("errors"),
    ).withColumn("gate_open", (F.col("failed") == 0) & (F.col("errors") == 0))
