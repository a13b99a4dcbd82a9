"""Row numbers within groups of any size, without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialise


def number_rows(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx`` (gapless from 0 within ``group``, by ``order``, nulls first) and ``n`` (rows of the group).

    The rows are range-partitioned and sorted once and written; a group's rows in a part are consecutive, so a
    part's smallest place and the rows of the parts before it give every row its number. Only one row for
    each (group, part) is shuffled besides. ``group`` must not be null.
    """
    keys = [group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, "placed").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        group,
        "_part",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    numbered = placed.join(parts, [group, "_part"]).withColumn("idx", F.col("_at") + F.col("_shift"))
    return numbered.drop("_at", "_part", "_shift")
