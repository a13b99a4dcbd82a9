"""Clean layer (C1-C8): an ordered rule fold per field, then table-level dedup.

Each field's rules wrap the previous expression in list order; fields without
rules pass through; everything lands in one ``select`` (one codegen stage).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.plans.spec import CleanRule, Dedup, Standard, spark_type

# --- fixed values: date formats tried by standardize_date, in order ---------
DEFAULT_DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy/MM/dd HH:mm:ss",
)
RULE_NAMES = ("trim_whitespace", "uppercase", "lowercase", "cast_type", "coalesce_null", "standardize_date", "deduplicate")
# --- end of fixed values ------------------------------------------------------


def trim_whitespace(c: Column) -> Column:
    """TRIM (spaces only, as in SQL)."""
    return F.trim(c)


def uppercase(c: Column) -> Column:
    """C2."""
    return F.upper(c)


def lowercase(c: Column) -> Column:
    """C3."""
    return F.lower(c)


def cast_type(c: Column, data_type: str | None, on_error: str = "raise") -> Column:
    """C4: CAST; bad values raise (ANSI) or become NULL with ``on_error='null'``."""
    if not data_type:
        return c
    t = spark_type(data_type)
    return c.try_cast(t) if on_error == "null" else c.cast(t)


def coalesce_null(c: Column, default: object | None, data_type: str | None = None) -> Column:
    """COALESCE with a literal default cast to the field's type; no default = no-op."""
    if default is None or default == "":
        return c
    d = F.lit(default)
    return F.coalesce(c, d.cast(data_type) if data_type else d)


def standardize_date(
    c: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS, data_type: str = "string", on_error: str = "null"
) -> Column:
    """Date or date-time text in any listed format -> DATE (first format that parses wins).

    A column that is a date or timestamp already (``data_type``) is cast. Blank text is NULL; other text that no
    format reads raises, or becomes NULL with ``on_error='null'`` (see :func:`unparsed_dates` for their number).
    """
    if data_type == "date" or data_type.startswith("timestamp"):
        return c.cast("date")
    text = F.trim(c.cast("string"))
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in formats])
    if on_error == "null":
        return parsed
    bad = parsed.isNull() & (text != "")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")).otherwise(parsed)


def unparsed_dates(df: DataFrame, fields: Sequence[str], formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> DataFrame:
    """Per field, how many values hold text that no date format reads: one row (one column per field), one pass."""

    def bad(name: str) -> Column:
        c = F.col(f"`{name}`")
        parsed = standardize_date(c, formats, df.select(c).schema[0].dataType.simpleString())
        return F.count_if(parsed.isNull() & (F.trim(c.cast("string")) != "")).alias(name)

    return df.agg(*[bad(f) for f in fields])


def clean_column(df: DataFrame, name: str, rule: CleanRule) -> Column:
    """The folded expression for one field (plan-time typing for coalesce defaults)."""
    expr = F.col(f"`{name}`")
    for r in rule.rules:
        if r == "trim_whitespace":
            expr = trim_whitespace(expr)
        elif r == "uppercase":
            expr = uppercase(expr)
        elif r == "lowercase":
            expr = lowercase(expr)
        elif r == "cast_type":
            expr = cast_type(expr, rule.cast_type, rule.on_error)
        elif r == "coalesce_null":
            current = df.select(expr.alias("x")).schema["x"].dataType.simpleString()
            expr = coalesce_null(expr, rule.default, current)
        elif r == "standardize_date":
            current = df.select(expr.alias("x")).schema["x"].dataType.simpleString()
            expr = standardize_date(expr, rule.date_formats or DEFAULT_DATE_FORMATS, current, rule.on_error)
        elif r == "deduplicate":
            continue  # table-level, see deduplicate()
        else:
            raise ValueError(f"unknown clean rule: {r}")
    return expr.alias(name)


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key, the greatest (``keep='last'``) or least ``order_by`` row.

    ``row_number() ... = 1`` is planned with a partial ``WindowGroupLimit``
    before the shuffle: every task keeps only its best row per key, so a key
    holding a third of the table sends one row per task, not its whole group.
    """
    order = [F.col(f"`{o}`").desc_nulls_last() if keep == "last" else F.col(f"`{o}`").asc_nulls_last() for o in order_by]
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def apply_clean_rules(
    df: DataFrame,
    rules: Sequence[CleanRule],
    dedup: Dedup | None = None,
    standard: Standard | None = None,
) -> DataFrame:
    """All field rules in one select (fields keep their order), dedup last.

    With a standard, ``cast_type`` without an explicit type casts to the field's type.
    """
    by_field = {}
    for r in rules:
        if r.field in by_field:
            raise ValueError(f"two rule lists for {r.field}")
        if standard and "cast_type" in r.rules and not r.cast_type and r.field in standard.names:
            r = CleanRule(r.field, r.rules, standard.field(r.field).data_type, r.default, r.date_formats, r.on_error)
        by_field[r.field] = r
    missing = set(by_field) - set(df.columns)
    if missing:
        raise ValueError(f"rules for unknown fields: {sorted(missing)}")
    if not dedup and any("deduplicate" in r.rules for r in rules):
        raise ValueError("a deduplicate rule needs keys: pass dedup=Dedup(keys, order_by)")
    out = df.select(*[clean_column(df, c, by_field[c]) if c in by_field else F.col(f"`{c}`") for c in df.columns])
    if dedup:
        out = deduplicate(out, dedup.keys, dedup.order_by, dedup.keep)
    return out
