"""Top values and value samples without a shuffle of all values.

* :func:`frequent_values`: Spark's frequent-items sketch of every column in one scan (bounded, mergeable partial results)
  gives candidates and a bound on the count of every other value; a second scan counts the candidates exactly. Where the
  k-th count lies above the bound, the result is proven; the other columns are counted in full, value by value.
* :func:`distinct_sample`: the k distinct values with the smallest hashes; only values below a hash threshold, which follows from
  the approximate number of distinct values, are shuffled.

Both run Spark jobs while they are called, and bring a few rows per column to the driver; which way a column took depends
on its counts, never on the size of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kiln.functions.common import ratio4
from kiln.operators.profile import groupable_columns, top_values

#: Items that a column's sketch keeps track of, and candidates for each value asked for.
TRACK, CANDIDATES = 8192, 10
#: A sketch's error, in parts of the rows over the items tracked, and the part of the items it holds without any error.
ERROR, EXACT_PART = 3.5, 0.75
#: Values expected below the hash threshold for each value asked for.
SPARE = 8


@dataclass(frozen=True)
class ColumnPlan:
    """What the summary of a column shows: ``bound`` is the largest count that a value outside the candidates may have."""

    column: str
    rows: int
    candidates: list
    bound: float
    counts: dict
    proven: bool


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _summaries(df: DataFrame, columns: list[str], k: int, track: int) -> list[tuple[str, int, list, float]]:
    """One scan: column, rows, candidates, bound."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.expr(f"approx_top_k(`{c}`, {CANDIDATES * k}, {track})").alias(f"t{i}"), F.approx_count_distinct(f"`{c}`").alias(f"d{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(columns):
        items = row[f"t{i}"] or []
        whole = row[f"d{i}"] * 1.15 < EXACT_PART * track  # three standard deviations below what the sketch holds as it is
        unseen = 0.0 if whole else 2 * ERROR * row["rows"] / track
        last = items[-1]["count"] if len(items) == CANDIDATES * k else 0
        out.append((c, row["rows"], [x["item"] for x in items], max(float(last), unseen)))
    return out


def _recount(df: DataFrame, found: list[tuple[str, int, list, float]]) -> dict[tuple[str, object], int]:
    """One scan: exact counts of all candidates, by column and text (None: null)."""
    picked = []
    for c, _, items, _ in found:
        values = [x for x in items if x is not None]
        chosen = F.col(f"`{c}`").isin(values) if values else F.lit(False)
        if None in items:
            chosen = F.col(f"`{c}`").isNull() | chosen
        picked.append(F.when(chosen, F.struct(F.lit(c).alias("column_name"), _text(c).alias("value"))))
    rows = df.select(F.explode(F.filter(F.array(*picked), lambda x: x.isNotNull())).alias("x")).select("x.*")
    counted = rows.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")).collect()  # candidates only
    return {(r.column_name, r.value): r.n for r in counted}


def plan_frequent(df: DataFrame, k: int = 5, columns: list[str] | None = None, track: int = TRACK) -> list[ColumnPlan]:
    """The summary and the exact counts of the candidates of every column, and whether they prove the ``k`` top values."""
    names = groupable_columns(df, columns)
    found = _summaries(df, names, k, track)
    counts = _recount(df, found) if found else {}
    plans = []
    for c, rows, items, bound in found:
        own = {v: n for (name, v), n in counts.items() if name == c}
        ranked = sorted(own.values(), reverse=True)
        # fewer values than asked for are all there are, if nothing is unseen
        proven = ranked[k - 1] > bound if len(ranked) >= k else bound == 0
        plans.append(ColumnPlan(c, rows, items, bound, own, proven))
    return plans


def frequent_values(
    df: DataFrame, k: int = 5, table_name: str = "", columns: list[str] | None = None, track: int = TRACK
) -> DataFrame:
    """P7 + P13: as :func:`kiln.operators.profile.top_values`, with no shuffle of a proven column's values.

    NULL is a group. Ties break on the value's text (NULL last). Columns: table_name, column_name, rank, value, count, frequency.
    """
    plans = plan_frequent(df, k, columns, track)
    rows = []
    for p in plans:
        if p.proven:
            best = sorted(p.counts.items(), key=lambda x: (-x[1], x[0] is None, (x[0] or "").encode()))[:k]
            rows += [(table_name, p.column, i, v, n, p.rows) for i, (v, n) in enumerate(best, 1)]
    proven = df.sparkSession.createDataFrame(
        rows, "table_name string, column_name string, rank int, value string, count long, __n long"
    ).select("table_name", "column_name", "rank", "value", "count", ratio4("count", "__n").alias("frequency"))
    rest = [p.column for p in plans if not p.proven]
    return proven.unionByName(top_values(df, k, table_name, rest)) if rest else proven


def distinct_sample(df: DataFrame, k: int = 5, table_name: str = "", columns: list[str] | None = None) -> DataFrame:
    """``k`` distinct non-NULL values per column, those with the smallest MD5 of their text.

    The same values whatever the order and number of the rows: a repeatable sample that favours neither frequent nor small values.
    Columns: table_name, column_name, rank, value.
    """
    names = groupable_columns(df, columns)
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], T.StructType.fromDDL("table_name string, column_name string, rank int, value string"))
    sizes = df.agg(*[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)]).first()
    share = {c: min(1.0, SPARE * k / max(1, sizes[f"d{i}"])) for i, c in enumerate(names)}
    got: dict[str, list[str]] = {}
    while todo := [c for c in names if c not in got]:
        best: dict[str, list[str]] = {c: [] for c in todo}
        for r in _smallest_hashes(df, {c: share[c] for c in todo}, k).collect():  # k rows per column
            best[r.column_name].append(r.value)
        for c in todo:  # too few below the threshold: a higher one
            if len(best[c]) >= k or share[c] >= 1:
                got[c] = best[c]
            else:
                share[c] = min(1.0, share[c] * SPARE)
    rows = [(table_name, c, i, v) for c in names for i, v in enumerate(got[c], 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, rank int, value string")


def _smallest_hashes(df: DataFrame, share: dict[str, float], k: int) -> DataFrame:
    """column_name and value of the ``k`` smallest hashes among those below each column's share of all hashes, in order."""
    picked = []
    for c, part in share.items():
        below = F.substring(F.md5(_text(c)), 1, 13) <= f"{int(part * 16**13):013x}" if part < 1 else F.lit(True)
        picked.append(F.when(F.col(f"`{c}`").isNotNull() & below, F.struct(F.lit(c).alias("column_name"), _text(c).alias("value"))))
    rows = df.select(F.explode(F.filter(F.array(*picked), lambda x: x.isNotNull())).alias("x")).select("x.*").distinct()
    w = Window.partitionBy("column_name").orderBy(F.md5("value"), "value")
    ranked = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.orderBy("column_name", "rank").select("column_name", "value")
