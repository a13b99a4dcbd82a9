"""Target standard from CSV (S6) and merging standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kiln.functions.common import strip_all
from kiln.plans.spec import Field, Standard

# fixed value: the standard file's header
STANDARD_COLUMNS = ("module", "table_name", "table_comment", "field_name", "field_type", "field_comment", "example")


def read_standard_csv(spark: SparkSession, path: str) -> DataFrame:
    """``target_fields`` rows: table_name, table_order, position, field_name, data_type, nullable,
    description, table_description. All text trimmed; tables keep first-seen order; the first
    row's comment describes the table; ``module`` and ``example`` are read and dropped.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = raw.select(*[strip_all(F.col(c)).alias(c) for c in STANDARD_COLUMNS if c in raw.columns]).withColumn(
        "__row", F.monotonically_increasing_id()
    )
    ftype = F.coalesce(F.col("field_type"), F.lit(""))
    nullable = ~ftype.rlike("(?i)not\\s+null")
    dtype = F.trim(F.regexp_replace(ftype, "(?i)\\s*not\\s+null\\s*", " "))
    per_table = Window.partitionBy("table_name").orderBy("__row")  # a standard has hundreds of rows at most
    first = rows.groupBy("table_name").agg(
        F.min("__row").alias("__first"), F.min_by(F.coalesce(F.col("table_comment"), F.lit("")), F.col("__row")).alias("table_description")
    )
    # one row per table of the standard: a global order over a bounded, small frame
    order = first.withColumn("table_order", F.dense_rank().over(Window.orderBy("__first")) - 1)
    return (
        rows.withColumn("position", F.row_number().over(per_table) - 1)
        .join(order, "table_name")
        .select(
            "table_name",
            F.col("table_order").cast("int").alias("table_order"),
            F.col("position").cast("int").alias("position"),
            "field_name",
            dtype.alias("data_type"),
            nullable.alias("nullable"),
            F.coalesce(F.col("field_comment"), F.lit("")).alias("description"),
            "table_description",
        )
    )


def standards_from_frame(fields: DataFrame) -> list[Standard]:
    """The ``target_fields`` frame as Standard specs (plan-time metadata; small)."""
    rows = fields.orderBy("table_order", "position").collect()
    out: dict[str, tuple[str, list[Field]]] = {}
    for r in rows:
        desc, fs = out.setdefault(r.table_name, (r.table_description or "", []))
        fs.append(Field(r.field_name, r.data_type, bool(r.nullable), r.description or ""))
    return [Standard(t, tuple(fs), d) for t, (d, fs) in out.items()]


def merge_standards(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append the tables of ``b`` that ``a`` lacks; ``b``'s tables go after ``a``'s."""
    last = a.agg(F.max("table_order")).first()[0]  # one number from a small metadata frame
    offset = 0 if last is None else last + 1
    new = b.join(a.select("table_name").distinct(), "table_name", "left_anti")
    return a.unionByName(new.withColumn("table_order", (F.col("table_order") + offset).cast("int")))
