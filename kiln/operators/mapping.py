"""Map layer (M1-M15): projections, joins, pre-aggregation, stacking, gap filling.

Joins are declared, not forced: a dimension side is broadcast when Spark's own
size check (``autoBroadcastJoinThreshold``; with AQE, the measured size of the
shuffled side at run time) says it fits, and sort-merge join is used otherwise.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.common import col_of
from kiln.plans.spec import Mapping, Standard, spark_type

log = logging.getLogger(__name__)


def _c(name: str) -> Column:
    return F.col(f"`{name}`") if "." not in name else F.col(name)


def map_column(m: Mapping, data_type: str | None = None) -> Column:
    """M1-M4: the Column for one mapping, aliased to the target field."""
    if m.kind == "direct":
        out = _c(m.source_field or m.target)
    elif m.kind == "transform":
        out = F.expr(m.expr) if m.expr else _c(m.source_field or m.target)
    elif m.kind == "merge":
        parts = [F.expr(s) for s in m.sources]
        if m.merge_how == "coalesce":
            out = F.coalesce(*parts)
        elif m.merge_how == "concat":
            out = F.concat_ws(m.separator, *[p.cast("string") for p in parts])
        elif m.merge_how == "sum":
            out = sum(parts[1:], parts[0])
        else:
            raise ValueError(f"unknown merge: {m.merge_how}")
    elif m.kind == "missing":
        out = F.lit(None).cast(spark_type(data_type) if data_type else "string")
    else:
        raise ValueError(f"unknown mapping kind: {m.kind}")
    return out.alias(m.target)


def build_map(df: DataFrame, mappings: Sequence[Mapping], standard: Standard | None = None) -> DataFrame:
    """Apply all mappings in one ``select``; ``missing`` fields are typed from the standard."""
    types = {f.name: f.data_type for f in standard.fields} if standard else {}
    return df.select(*[map_column(m, types.get(m.target)) for m in mappings])


def enrich(
    df: DataFrame,
    dim: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str] | None = None,
    fields: Sequence[str] | None = None,
    how: str = "left",
    matched: str | None = None,
) -> DataFrame:
    """M6: join a side table on its key, taking only the named fields.

    ``matched`` names a column that says whether a row found its partner, for the evidence in
    :func:`kiln.operators.standard.coverage_audit`.
    """
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    take = list(fields) if fields is not None else [c for c in dim.columns if c not in rk]
    alias = [f"__k{i}" for i in range(len(rk))]
    side = dim.select(*[_c(r).alias(a) for r, a in zip(rk, alias)], *[_c(f) for f in take])
    cond = [df[f"`{left}`"] == side[a] for left, a in zip(lk, alias)]
    joined = df.join(side, cond, how)
    if matched:
        joined = joined.withColumn(matched, side[alias[0]].isNotNull())
    return joined.drop(*alias)


def preaggregate_join(
    one: DataFrame,
    many: DataFrame,
    one_key: str,
    many_key: str,
    aggs: dict[str, Column],
    zero_fill: Sequence[str] = (),
    how: str = "left",
) -> DataFrame:
    """M7: group the many side on its key first, then join, so rows never multiply.

    The aggregate has map-side partial aggregation (a key holding a third of
    the rows shrinks to one row per task before the shuffle) and its output is
    already hash-partitioned on the key for the join. ``zero_fill`` columns
    (counts, sums) become 0 where the one side has no partner.
    """
    agg = many.groupBy(_c(many_key).alias("__key")).agg(*[c.alias(n) for n, c in aggs.items()])
    joined = one.join(agg, one[f"`{one_key}`"] == agg["__key"], how).drop("__key")
    if zero_fill:
        joined = joined.withColumns({n: F.coalesce(_c(n), F.lit(0)) for n in zero_fill})
    return joined


def stack_sources(frames: dict[str, DataFrame], source_column: str = "source_table") -> DataFrame:
    """M8: several tables holding the same entity, stacked by column name."""
    names = list(frames)
    out = frames[names[0]].withColumn(source_column, F.lit(names[0]))
    for n in names[1:]:
        out = out.unionByName(frames[n].withColumn(source_column, F.lit(n)), allowMissingColumns=True)
    return out


@dataclass(frozen=True)
class SideTable:
    """A table that gaps may take fields from: joined on its key (left join; a key that repeats raises when the plan runs)."""

    frame: DataFrame
    left_on: str
    right_on: str


def _same_name(df: DataFrame, a: str, b: str) -> bool:
    """Whether two names are the same under the session's letter-case rule."""
    return a == b if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else a.lower() == b.lower()


def _has(df: DataFrame, name: str) -> bool:
    """Whether the session resolves ``name`` in ``df`` (its letter-case rule included)."""
    return any(_same_name(df, c, name) for c in df.columns)


def missing_gaps(df: DataFrame, gaps: Sequence[Mapping], others: dict[str, SideTable] | None = None) -> list[str]:
    """Targets :func:`gap_fill` can only fill with NULL: missing by kind, or no table at hand holds their field."""
    out = []
    for g in gaps:
        side = (others or {}).get(g.source_table or "")
        known = _has(df, g.source_field or g.target) or (side is not None and _has(side.frame, g.source_field or g.target))
        if g.kind == "missing" or g.kind == "direct" and not known:
            out.append(g.target)
    return out


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"(?<![\w`.]){re.escape(name)}(?!\w|\s*\.)|(?<!\.)`{re.escape(name)}`(?!\s*\.)", text, re.IGNORECASE) is not None


def _qualified(text: str, table: str, name: str) -> bool:
    return re.search(rf"(?<!\w)`?{re.escape(table)}`?\s*\.\s*`?{re.escape(name)}`?(?!\w)", text, re.IGNORECASE) is not None


def side_fields(df: DataFrame, gaps: Sequence[Mapping], others: dict[str, SideTable]) -> dict[str, tuple[list[str], list[str]]]:
    """What the gaps need of each side table: (fields taken by their own name, fields taken as ``table.field``).

    A direct field that ``df`` lacks comes from the gap's table. In an expression (transform, merge) a name is ``df``'s own column
    where it has one, else a field of a side table that has it, the gap's own table first; two other tables that both have it
    raise, and ``table.field`` names one of them.
    """
    plain, named = {t: [] for t in others}, {t: [] for t in others}
    for g in gaps:
        own = others.get(g.source_table or "")
        if g.kind == "direct" and not _has(df, g.source_field or g.target):
            if own is not None and _has(own.frame, g.source_field or g.target):
                named[g.source_table].append(g.source_field or g.target)
        if g.kind not in ("transform", "merge"):
            continue
        text = " , ".join([g.expr or "", *(g.sources or ())])
        owners: dict[str, list[str]] = {}
        for table, side in others.items():
            for c in side.frame.columns:
                if _qualified(text, table, c):
                    named[table].append(c)
                elif _mentions(text, c) and not _has(df, c):
                    owners.setdefault(c.lower(), []).append(table)
        for c, tables in owners.items():
            if len(tables) > 1 and g.source_table not in tables:
                raise ValueError(f"{g.target}: {c} is a field of {sorted(tables)}; write table.{c}")
            table = g.source_table if g.source_table in tables else tables[0]
            plain[table].append(next(x for x in others[table].frame.columns if x.lower() == c))
    return {t: (list(dict.fromkeys(plain[t])), list(dict.fromkeys(named[t]))) for t in others if plain[t] or named[t]}


def unique_side(side: SideTable, table: str, fields: Sequence[str]) -> DataFrame:
    """The side table's key (``__on``) and fields, one row per key; a key that repeats raises when the plan runs.

    The rows are grouped on the join key, by which they are shuffled for the join anyhow. Rows without a key match nothing and go.
    """
    key = _c(side.right_on)
    kept = side.frame.where(key.isNotNull()).select(key.alias("__on"), F.struct(*[_c(f).alias(f) for f in fields]).alias("__row"))
    once = kept.groupBy("__on").agg(F.any_value("__row").alias("__row"), F.count(F.lit(1)).alias("__n"))
    text = F.concat(F.lit(f"gap_fill: key {side.right_on} of {table} repeats: "), F.col("__on").cast("string"))
    return once.select("__on", F.when(F.col("__n") > 1, F.raise_error(text)).otherwise(F.col("__row")).alias("__row"))


def gap_fill(
    df: DataFrame, gaps: Sequence[Mapping], standard: Standard | None = None, others: dict[str, SideTable] | None = None
) -> DataFrame:
    """M9: add uncovered target fields (transform, merge, else source field, else typed NULL).

    Fields of other tables in ``others``, direct ones and those that expressions mention (:func:`side_fields`), are found
    when the plan is made and brought in by joining each table once (M6); a table whose key repeats raises
    (:func:`unique_side`), so no row is ever multiplied. Fields that no table holds become NULL, with a warning;
    :func:`missing_gaps` lists them.
    """
    types = {f.name: f.data_type for f in standard.fields} if standard else {}
    others = others or {}
    empty = set(missing_gaps(df, gaps, others))
    if empty:
        log.warning("filled with NULL: %s", sorted(empty))
    before = df.columns
    needed = side_fields(df, [g for g in gaps if g.target not in empty], others)
    wide = df
    for table, (plain, named) in needed.items():
        fields = list(dict.fromkeys([*plain, *named]))
        side = unique_side(others[table], table, fields)
        if named and _has(df, table):
            raise ValueError(f"the table {table} has the name of a column; name it otherwise in others")
        side = side.select("__on", *[F.col(f"__row.`{f}`").alias(f) for f in plain], *([F.col("__row").alias(table)] if named else []))
        wide = enrich(wide, side, others[table].left_on, "__on")
    cols = {}
    for g in gaps:
        if g.target in empty:
            cols[g.target] = map_column(replace(g, kind="missing"), types.get(g.target))
        elif g.kind == "direct" and not _has(df, g.source_field or g.target):
            cols[g.target] = F.col(f"`{g.source_table}`.`{g.source_field or g.target}`").alias(g.target)
        else:
            cols[g.target] = map_column(g, types.get(g.target))
    own = [next((cols[t] for t in cols if _same_name(df, t, c)), None) for c in before]
    kept = [_c(c) if new is None else new for c, new in zip(before, own)]
    return wide.select(*kept, *[col for t, col in cols.items() if not _has(df, t)])


def fanout_forecast(
    base: DataFrame, side: DataFrame, left_on: str | Sequence[str], right_on: str | Sequence[str] | None = None, how: str = "inner"
) -> DataFrame:
    """M10 before the join: the rows it will have, without making them.

    Each side is counted by key (partial aggregation: a key with a third of all rows is one row per task), and the counts are
    multiplied on one row per key. One row: base_rows, joined_rows, repeated_keys (keys with more than one joined
    row), max_rows_per_key, inflated. ``how`` is inner or left (rows without a partner, and null keys, stay).
    """
    stats = _key_counts(base, side, left_on, right_on, how).agg(
        F.coalesce(F.sum("base_rows"), F.lit(0)).cast("long").alias("base_rows"),
        F.coalesce(F.sum("joined_rows"), F.lit(0)).cast("long").alias("joined_rows"),
        F.count_if(F.col("joined_rows") > 1).cast("long").alias("repeated_keys"),
        F.coalesce(F.max("joined_rows"), F.lit(0)).cast("long").alias("max_rows_per_key"),
    )
    return stats.withColumn("inflated", F.col("joined_rows") > F.col("base_rows"))


def fanout_keys(
    base: DataFrame, side: DataFrame, left_on: str | Sequence[str], right_on: str | Sequence[str] | None = None, how: str = "inner", k: int = 10
) -> DataFrame:
    """The ``k`` keys that a join multiplies most: the key, base_rows, side_rows, joined_rows (ties: smallest key)."""
    keys = [left_on] if isinstance(left_on, str) else list(left_on)
    counts = _key_counts(base, side, left_on, right_on, how).where("joined_rows > base_rows")
    return counts.orderBy(F.desc("joined_rows"), *[F.asc(f"`{c}`") for c in keys]).limit(k)


def _key_counts(base: DataFrame, side: DataFrame, left_on, right_on, how: str) -> DataFrame:
    """Per key of ``base``: the key, base_rows, side_rows (null keys: 0), joined_rows."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    lk = [left_on] if isinstance(left_on, str) else list(left_on)
    rk = lk if right_on is None else ([right_on] if isinstance(right_on, str) else list(right_on))
    left = base.groupBy(*[_c(c) for c in lk]).agg(F.count(F.lit(1)).alias("base_rows"))
    right = side.groupBy(*[_c(c).alias(f"__k{i}") for i, c in enumerate(rk)]).agg(F.count(F.lit(1)).alias("side_rows"))
    joined = left.join(right, [left[f"`{c}`"] == right[f"__k{i}"] for i, c in enumerate(lk)], "left")
    pairs = F.col("base_rows") * F.coalesce("side_rows", F.lit(0))
    rows = F.when(F.coalesce("side_rows", F.lit(0)) == 0, F.col("base_rows")).otherwise(pairs) if how == "left" else pairs
    return joined.select(
        *[left[f"`{c}`"] for c in lk], "base_rows", F.coalesce("side_rows", F.lit(0)).alias("side_rows"), rows.alias("joined_rows")
    )


def fanout_audit(base: DataFrame, joined: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Did a join multiply rows? One row: base_rows, joined_rows, repeated_keys, max_rows_per_key, inflated."""
    keys = [key] if isinstance(key, str) else list(key)
    per_key = joined.groupBy(*[_c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    stats = per_key.agg(
        F.sum("n").cast("long").alias("joined_rows"),
        F.count_if(F.col("n") > 1).cast("long").alias("repeated_keys"),
        F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_rows_per_key"),
    )
    names = ["joined_rows", "repeated_keys", "max_rows_per_key"]
    b = base.agg(F.count(F.lit(1)).alias("base_rows")).select(
        "base_rows", *[F.lit(None).cast("long").alias(n) for n in names]
    )
    s = stats.select(F.lit(None).cast("long").alias("base_rows"), *names)
    # two one-row aggregates merged by a union + max: no join between them
    out = b.unionByName(s).agg(*[F.max(n).alias(n) for n in ["base_rows", *names]])
    return out.withColumn("inflated", F.col("joined_rows") > F.col("base_rows"))


def unprotected_not_null(df: DataFrame, standard: Standard) -> DataFrame:
    """NOT NULL target fields that hold NULLs, with their count (one pass)."""
    required = [f.name for f in standard.fields if not f.nullable and f.name in df.columns]
    if not required:
        return df.sparkSession.createDataFrame([], "field string, null_rows long")
    wide = df.agg(*[F.count_if(_c(n).isNull()).alias(n) for n in required])
    long = wide.unpivot([], required, "field", "null_rows")
    return long.filter(F.col("null_rows") > 0)


def normalise_key(c: Column | str) -> Column:
    """``MRN-007`` -> 7, ``42`` -> 42; trailing digits as bigint, NULL when none."""
    digits = F.regexp_extract(col_of(c).cast("string"), "([0-9]+)$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def bucket(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """CASE categories; label i covers ``edges[i-1] <= x < edges[i]``."""
    if len(labels) != len(edges) + 1:
        raise ValueError("need one label more than edges")
    x = col_of(c)
    expr = F.when(x.isNull(), F.lit(None).cast("string"))
    for e, label in zip(edges, labels):
        expr = expr.when(x < e, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def year_of(c: Column | str) -> Column:
    """Calendar year."""
    return F.year(col_of(c))


def age_years(birth: Column | str, as_of: Column | str) -> Column:
    """Whole calendar years from ``birth`` to ``as_of`` (one less before the birthday)."""
    b, a = col_of(birth), col_of(as_of)
    before = (F.month(a) < F.month(b)) | ((F.month(a) == F.month(b)) & (F.dayofmonth(a) < F.dayofmonth(b)))
    return (F.year(a) - F.year(b) - before.cast("int")).cast("int")


def flag(c: Column | str, value: object) -> Column:
    """1 when the column equals ``value``, 0 otherwise (NULL stays NULL)."""
    x = col_of(c)
    return F.when(x.isNull(), F.lit(None).cast("int")).when(x == F.lit(value), 1).otherwise(0)


def cast_nullsafe(c: Column | str, data_type: str, default: object | None = None, strict: bool = True) -> Column:
    """CAST to the target type (``try_cast`` when not strict) and COALESCE for NOT NULL targets."""
    t = spark_type(data_type)
    x = col_of(c).cast(t) if strict else col_of(c).try_cast(t)
    return F.coalesce(x, F.lit(default).cast(t)) if default is not None else x
