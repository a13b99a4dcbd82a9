"""Target standard (T3, T4, T6): conform, coverage audit, readiness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.common import ratio4
from kiln.plans.spec import Standard


def conform(df: DataFrame, standard: Standard, strict: bool = False) -> DataFrame:
    """Exactly the standard's fields, in its order, cast to its types.

    Absent fields become typed NULLs; with ``strict`` an absent NOT NULL field
    raises instead. NOT NULL itself is enforced by the quality checks.
    """
    cols = []
    for f in standard.fields:
        if f.name in df.columns:
            cols.append(F.col(f"`{f.name}`").cast(f.spark_type).alias(f.name))
        elif strict and not f.nullable:
            raise ValueError(f"{standard.table}.{f.name} is NOT NULL and absent")
        else:
            cols.append(F.lit(None).cast(f.spark_type).alias(f.name))
    return df.select(*cols)


@dataclass(frozen=True)
class JoinEvidence:
    """A join of the model: the column that says whether a row found its partner, and the target fields taken from the partner."""

    name: str
    matched: str
    fields: tuple[str, ...]


def coverage_audit(df: DataFrame, standard: Standard, joins: Sequence[JoinEvidence] = ()) -> DataFrame:
    """T4: per target field: present?, filled rows, fill rate, expected vs actual type.

    The schema comparison is plan-time (Spark knows the model output); fill
    counts are one aggregate over the model output. ``joins`` adds the columns join_name and match_rate, for the fields taken
    from a join, measured in the same aggregate (null for the other fields).
    """
    actual = {f.name: f.dataType for f in df.schema.fields}
    present = [f.name for f in standard.fields if f.name in actual]
    found = [F.count_if(F.col(f"`{j.matched}`")).alias(f"m{i}") for i, j in enumerate(joins)]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{n}`")).alias(f"f{i}") for i, n in enumerate(present)], *found)
    join_of = {f: (i, j.name) for i, j in enumerate(joins) for f in j.fields}
    idx = {n: i for i, n in enumerate(present)}
    items = []
    for pos, f in enumerate(standard.fields):
        expected = T._parse_datatype_string(f.spark_type).simpleString()
        got = actual[f.name].simpleString() if f.name in actual else None
        filled = F.col(f"f{idx[f.name]}") if f.name in idx else F.lit(0).cast("long")
        items.append(
            F.struct(
                F.lit(pos).alias("position"),
                F.lit(f.name).alias("field_name"),
                F.lit(f.name in actual).alias("present"),
                filled.cast("long").alias("filled_rows"),
                F.lit(expected).alias("expected_type"),
                F.lit(got).cast("string").alias("actual_type"),
                F.lit(got == expected).alias("type_match"),
                F.lit(f.nullable).alias("nullable"),
                *(_evidence(join_of.get(f.name)) if joins else []),
            )
        )
    out = wide.select(F.col("__rows").alias("row_count"), F.explode(F.array(*items)).alias("s")).select("row_count", "s.*")
    return out.select(
        F.lit(standard.table).alias("table_name"),
        "position",
        "field_name",
        "present",
        "row_count",
        "filled_rows",
        ratio4("filled_rows", "row_count").alias("fill_rate"),
        "expected_type",
        "actual_type",
        "type_match",
        "nullable",
        *(["join_name", ratio4("matched_rows", "row_count").alias("match_rate")] if joins else []),
    )


def _evidence(join: tuple[int, str] | None) -> list[Column]:
    matched = F.lit(None).cast("long") if join is None else F.col(f"m{join[0]}").cast("long")
    return [F.lit(join[1] if join else None).cast("string").alias("join_name"), matched.alias("matched_rows")]


def readiness(coverage: DataFrame, auto_at: float = 0.9, suggest_at: float = 0.7, suggest_max_uncovered: int = 3) -> DataFrame:
    """Per target table, mean confidence and a recommendation.

    Confidence of a field = its measured fill rate (0 when absent), or the match rate of the join it comes from where that is
    known and lower (a default value fills a field that nothing was found for); the table's
    confidence is the mean. ``auto`` at >= 0.9 with nothing uncovered,
    ``suggest`` at >= 0.7 with at most 3 uncovered, else ``manual``.
    """
    sure = F.least("fill_rate", "match_rate") if "match_rate" in coverage.columns else F.col("fill_rate")  # least skips nulls
    conf = F.when(F.col("present"), sure).otherwise(0.0)
    per_table = coverage.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("fields"),
        F.count_if(~F.col("present")).alias("uncovered"),
        F.sum(F.round(conf * 10000).cast("long")).alias("__conf_units"),
    )
    per_table = per_table.withColumn(
        "confidence", ratio4("__conf_units", F.col("fields") * 10000)
    ).drop("__conf_units")
    rec = (
        F.when((F.col("confidence") >= auto_at) & (F.col("uncovered") == 0), "auto")
        .when((F.col("confidence") >= suggest_at) & (F.col("uncovered") <= suggest_max_uncovered), "suggest")
        .otherwise("manual")
    )
    return per_table.withColumn("recommendation", rec)


def readiness_report(coverage: DataFrame, standards: Sequence[Standard], **limits) -> DataFrame:
    """T6 for all target tables: :func:`readiness`, and the risk of each.

    A target table that no audited model fills (it has no row in ``coverage``) is a ``high`` risk: all its fields are uncovered and its
    confidence is 0. A field that must not be null but is absent or has gaps is a ``medium`` risk, everything else ``low``.
    """
    spark = coverage.sparkSession
    ready = readiness(coverage, **limits)
    weak = coverage.groupBy("table_name").agg(F.count_if(~F.col("nullable") & (F.col("filled_rows") < F.col("row_count"))).alias("__gaps"))
    targets = spark.createDataFrame([(s.table, len(s.fields)) for s in standards], "table_name string, __fields long")
    out = targets.join(ready, "table_name", "left").join(weak, "table_name", "left")
    absent = F.col("fields").isNull()
    risk = F.when(absent, "high").when(F.col("__gaps") > 0, "medium").otherwise("low")
    return out.select(
        "table_name",
        F.coalesce("fields", "__fields").alias("fields"),
        F.coalesce("uncovered", "__fields").alias("uncovered"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("recommendation", F.lit("manual")).alias("recommendation"),
        risk.alias("risk"),
    )
