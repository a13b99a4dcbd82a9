"""PII operators (I3-I5, I11) over whole columns.

Values are unpivoted to ``(column_name, value)``, labelled by Column
expressions (no UDF), and counted with partial aggregation. The scan result is
one row per column, small enough to drive the masking plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.common import digits_only, fixed_expr, ratio4, strip_all
from kiln.functions.pii import (
    LABELS,
    key_hint_expr,
    labels_of_stripped,
    mask_by_kind,
    mask_kind_expr,
    mask_value,
    name_has_key_hint,
)
from kiln.plans.names import name_is_sensitive, pii_types_by_name

SCAN_SCHEMA = "column_name string, detected_by string, samples long, pii_ratio double, pii_types string, sensitive_name boolean"


def _text_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    from kiln.operators.profile import groupable_columns

    return groupable_columns(df, list(columns) if columns else None)


def pii_values(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """I3 + I4 per value: ``keep`` columns, column_name, value, pii_types (comma-joined, ``''`` when none)."""
    cols = _text_columns(df, columns)
    ids = [f"__keep{i}" for i in range(len(keep))]
    long = df.select(
        *[F.col(f"`{k}`").alias(i) for k, i in zip(keep, ids)], *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]
    ).unpivot(ids, [f"`{c}`" for c in cols], "column_name", "value")
    return _labelled(long.withColumnsRenamed(dict(zip(ids, keep))))


def _labelled(long: DataFrame) -> DataFrame:
    """Add pii_types to (column_name, value)."""
    # stripped text and its digits in their own projection: computed once, not per pattern
    strip, digits, labels = _label_exprs()
    prep = long.withColumn("__s", strip).withColumn("__d", digits)
    return prep.withColumn("pii_types", labels).drop("__s", "__d")


@fixed_expr
def _label_exprs() -> tuple[Column, Column, Column]:
    hint = key_hint_expr(F.col("column_name"))
    return strip_all(F.col("value")), digits_only(F.col("__s")), labels_of_stripped(F.col("__s"), F.col("__d"), hint)


@fixed_expr
def _token_label_exprs(hint: bool) -> tuple[Column, Column, Column]:
    return strip_all(F.col("token")), digits_only(F.col("__s")), labels_of_stripped(F.col("__s"), F.col("__d"), hint)


@fixed_expr
def _scan_exprs() -> tuple[Column, tuple[Column, ...], Column]:
    """Per-column folding of labelled values: tagged labels, the aggregates, the top three labels."""
    tagged = F.concat(F.lit(","), F.col("pii_types"), F.lit(",")).alias("__p")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("value").isNotNull() & cond, F.col("count"))), F.lit(0))

    aggs = (
        total(F.lit(True)).alias("samples"),
        total(F.col("__p") != ",,").alias("hits"),
        *[total(F.col("__p").contains(f",{lab},")).alias(f"__n{i}") for i, lab in enumerate(LABELS)],
    )
    # up to three labels by count, ties in label order: struct order (-count, position)
    ranked = F.array(*[F.struct((-F.col(f"__n{i}")).alias("k"), F.lit(i).alias("o"), F.lit(lab).alias("label")) for i, lab in enumerate(LABELS)])
    top3 = F.slice(F.array_sort(F.filter(ranked, lambda x: x["k"] < 0)), 1, 3)
    return tagged, aggs, F.array_join(F.transform(top3, lambda x: x["label"]), ",").alias("value_types")


def pii_scan(
    df: DataFrame,
    threshold: float = 0.3,
    columns: Sequence[str] | None = None,
    sample_fraction: float | None = None,
    seed: int = 17,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Which columns hold personal data, and of which types.

    A name hit (I2) wins outright. Otherwise the share of non-NULL values with
    any label must reach ``threshold``; the up to three most frequent labels
    are reported (ties in label order). The whole column is scanned unless a
    ``sample_fraction`` is given. ``counts`` are the whole table's :func:`value_counts` where the caller has them: every distinct
    value is then labelled once and counts as often as it occurs.
    """
    cols = _text_columns(df, columns)
    if counts is None:
        src = df.sample(fraction=sample_fraction, seed=seed) if sample_fraction else df
        labeled = pii_values(src, cols).filter(F.col("value").isNotNull()).withColumn("count", F.lit(1))
    elif sample_fraction:
        raise ValueError("counts are of the whole table: no sample_fraction")
    else:
        labeled = _labelled(counts)  # NULL goes in the aggregates: a filter would sink below the counts and split their exchange
    # values are labelled once and folded by one partial aggregation per column:
    # the share with any label and a count per label (a fixed, small set)
    tagged, aggs, value_types = _scan_exprs()
    per_col = labeled.select("column_name", "value", "count", tagged).groupBy("column_name").agg(*aggs)
    per_col = per_col.select("column_name", "samples", "hits", value_types)
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(c, ",".join(pii_types_by_name(c)), name_is_sensitive(c), i) for i, c in enumerate(cols)],
        "column_name string, name_types string, sensitive_name boolean, position int",
    )
    # every frame here has one row per column: tiny joins whatever the table size
    j = names.join(F.broadcast(per_col), "column_name", "left")
    samples = F.coalesce(F.col("samples"), F.lit(0)).cast("long")
    ratio = ratio4(F.coalesce(F.col("hits"), F.lit(0)), samples)
    by_value = (samples > 0) & (F.coalesce(F.col("hits"), F.lit(0)) > 0) & (ratio >= threshold)
    detected = F.when(F.col("name_types") != "", "name").when(by_value, "value").otherwise("none")
    types = F.when(F.col("name_types") != "", F.col("name_types")).when(by_value, F.col("value_types")).otherwise(F.lit(""))
    return j.select(
        "column_name",
        detected.alias("detected_by"),
        samples.alias("samples"),
        ratio.alias("pii_ratio"),
        types.alias("pii_types"),
        "sensitive_name",
        "position",
    ).repartition(1).sortWithinPartitions("position").drop("position")  # one row per column: no range sampling job


def mask_plan(scan: DataFrame) -> dict[str, list[str]]:
    """Columns to mask and their types, from a scan (one row per column: fine to collect)."""
    rows = scan.filter((F.col("detected_by") != "none") | F.col("sensitive_name")).collect()
    return {r["column_name"]: [t for t in (r["pii_types"] or "").split(",") if t] for r in rows}


def mask_table(
    df: DataFrame, plan: dict[str, list[str]] | DataFrame | None = None, threshold: float = 0.3, strict: bool = False
) -> DataFrame:
    """Mask every sensitive column of the whole table (name rule, address, birth date, default).

    ``strict`` also hides the second character of two-character values.

    ``plan`` is a scan result, a ``{column: types}`` dict, or None (scan first).
    """
    if plan is None:
        plan = pii_scan(df, threshold)
    if isinstance(plan, DataFrame):
        plan = mask_plan(plan)
    return df.withColumns({c: mask_value(F.col(f"`{c}`"), types, c, strict) for c, types in plan.items() if c in df.columns})


def pii_tokens(df: DataFrame, text_column: str, keep: Sequence[str] = ()) -> DataFrame:
    """I3 over whitespace tokens of whole texts: ``keep``, label, tokens (count per row and label).

    Tokens without a digit, ``@`` or CJK character cannot match any pattern,
    so they are never extracted (exact, not a sample).
    """
    # Only candidate tokens become rows: a whole token (run of non-whitespace that
    # starts after whitespace or at the start) holding a candidate character.
    # Same tokens as splitting on whitespace and filtering, without a row per word.
    token = "(?<![^ \\t\\n\\r\\f])[^ \\t\\n\\r\\f]*?[0-9@一-鿿][^ \\t\\n\\r\\f]*"
    candidates = df.select(
        *[F.col(k) for k in keep], F.explode(F.regexp_extract_all(F.col(f"`{text_column}`"), F.lit(token), 0)).alias("token")
    )
    strip, digits, label_expr = _token_label_exprs(name_has_key_hint(text_column))
    prep = candidates.withColumn("__s", strip).withColumn("__d", digits)
    labels = prep.select(*keep, label_expr.alias("labels")).filter(F.col("labels") != "")
    labeled = labels.select(*keep, F.explode(F.split("labels", ",")).alias("label"))
    return labeled.groupBy(*keep, "label").agg(F.count(F.lit(1)).alias("tokens"))


def mask_profile(
    profile: DataFrame, plan: dict[str, list[str]] | DataFrame, strict: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """I11 for profiles: mask min/max, top values and samples of sensitive columns.

    ``plan`` is a scan result (joined by column name, one row per column, so
    nothing reaches the driver and the mask kind is a Column expression) or a
    ``{column: types}`` dict (the mask is then chosen per row with a CASE over
    the few sensitive column names). The profile of a sensitive column never
    shows a value in clear. ``keep`` names scan columns to carry along.
    """
    if isinstance(plan, DataFrame):
        flag_cols, masks = _profile_mask_exprs(tuple(c for c in PROFILE_VALUE_COLUMNS if c in profile.columns), strict)
        flags = plan.select(*flag_cols, *keep)
        joined = profile.join(F.broadcast(flags), profile["column_name"] == flags["__col"], "left")
        return joined.withColumns(masks).drop("__col", "__flag", "__kind")

    def masked_by_name(c: Column) -> Column:
        out = None
        for name, types in plan.items():
            m = mask_value(c, types, name, strict)
            out = F.when(F.col("column_name") == name, m) if out is None else out.when(F.col("column_name") == name, m)
        return c if out is None else out.otherwise(c)

    return _mask_profile_columns(profile, masked_by_name)


PROFILE_VALUE_COLUMNS = ("min_value", "max_value", "sample_values", "top_values")


@fixed_expr
def _profile_mask_exprs(present: tuple[str, ...], strict: bool) -> tuple[tuple[Column, ...], dict[str, Column]]:
    """Scan flags (one row per column) and the masks of a profile's value columns, chosen by ``__kind``."""
    flags = (
        F.col("column_name").alias("__col"),
        ((F.col("detected_by") != "none") | F.col("sensitive_name")).alias("__flag"),
        mask_kind_expr(F.col("pii_types"), F.col("column_name")).alias("__kind"),
    )

    def masked(c: Column) -> Column:
        return F.when(F.coalesce(F.col("__flag"), F.lit(False)), mask_by_kind(c, F.col("__kind"), strict)).otherwise(c)

    return flags, _value_masks(present, masked)


def _value_masks(present, masked) -> dict[str, Column]:
    out = {c: masked(F.col(c)) for c in ("min_value", "max_value") if c in present}
    if "sample_values" in present:
        out["sample_values"] = F.transform("sample_values", masked)
    if "top_values" in present:
        out["top_values"] = F.transform("top_values", lambda s: s.withField("value", masked(s["value"])))
    return out


def _mask_profile_columns(profile: DataFrame, masked) -> DataFrame:
    return profile.withColumns(_value_masks(tuple(profile.columns), masked))
