"""Clean and mask a stream with the batch operators' own expressions.

Column rules (trim, case, cast, coalesce, date parsing) and masks are
stateless Column expressions, so the batch code runs unchanged on a
``readStream``. Table-level dedup, which in batch is a ranking window, becomes
``dropDuplicatesWithinWatermark``: state per key is kept only as long as the
watermark allows, so it stays bounded on an endless stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kiln.operators.cleaning import apply_clean_rules
from kiln.operators.pii import mask_table
from kiln.plans.spec import CleanRule


def clean_stream(
    stream: DataFrame,
    rules: Sequence[CleanRule] = (),
    mask: dict[str, list[str]] | None = None,
    dedup_keys: Sequence[str] = (),
    event_time: str | None = None,
    watermark: str = "1 hour",
) -> DataFrame:
    """Apply clean rules, masks and watermark-bounded dedup to a streaming DataFrame."""
    out = apply_clean_rules(stream, rules) if rules else stream
    if mask:
        out = mask_table(out, mask)
    if dedup_keys:
        if not event_time:
            raise ValueError("dedup on a stream needs an event-time column for the watermark")
        # watermarks need TIMESTAMP; a TIMESTAMP_NTZ event time is read in the session time zone
        wm = "__event_time"
        out = out.withColumn(wm, F.col(f"`{event_time}`").cast("timestamp"))
        out = out.withWatermark(wm, watermark).dropDuplicatesWithinWatermark(list(dedup_keys)).drop(wm)
    return out


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """A file-source stream over ``folder`` (new files are picked up as they land)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(folder)


def write_available(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything available now, exactly once, then stop (checkpointed in the shared folder)."""
    return (
        df.writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
