"""Sharding by a Hilbert curve over metadata.

Every row gets a small integer level per metadata dimension, the levels are
mapped to a position on a Hilbert curve, and the rows sorted by that position
are cut into runs of equal row count. Neighbours on the curve are close in
every dimension, so each shard covers narrow ranges of all of them and a reader
can skip files by min/max.

The sort never puts all rows through one task: the curve has at most
``2 ** (bits * dims)`` cells, so a histogram of cells (proven bound) gives every
cell its first rank, cells holding many rows are divided into hash ranges of
about ``rows_per_bucket`` rows, and ranks are counted inside those ranges only.
A source or copy group with a third of all rows is divided like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialise, table, text_crc32

#: Upper bound of bits * dims: the cell table is broadcast and holds at most 2**15 rows.
MAX_CELL_BITS = 15


@dataclass(frozen=True)
class Dim:
    """A metadata dimension. ``kind`` is ``log`` (number, one level per power of two)
    or ``rank`` (any orderable value, levels of about equal row count in value order)."""

    column: str
    kind: str = "rank"


def log_level(value: Column, bits: int) -> Column:
    """floor(log2(value)) without floating point, clipped to the levels; null or below 1 gives 0."""
    v = F.greatest(F.coalesce(value.cast("long"), F.lit(1)), F.lit(1))
    return F.least(F.length(F.bin(v)) - 1, F.lit(2**bits - 1)).cast("int")


def rank_levels(df: DataFrame, column: str, out: str, bits: int) -> DataFrame:
    """Level of each distinct value: its place among all rows in value order (null first).

    One row per distinct value after partial aggregation; the window runs over those.
    """
    counts = df.groupBy(F.col(column).alias(f"{out}_value")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.col(f"{out}_value").asc_nulls_first())
    before = F.sum("n").over(order) - F.col("n")
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(f"{out}_value", F.floor(before * (2**bits) / total).cast("int").alias(out))


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point given by ``bits``-bit levels.

    Gray-code construction by bit planes (Skilling, "Programming the Hilbert
    curve", 2004), written with higher-order functions over an array of levels.
    """
    n = len(levels)
    start = F.array(*[c.cast("int") for c in levels])
    last = F.lit(n - 1)

    def turn(x: Column, q: int, i: int) -> Column:
        p, xi, x0 = F.lit(q - 1), x[i], x[0]
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        flip = xi.bitwiseAND(F.lit(q)) != 0
        return F.when(
            flip, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(p)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    def chained(x: Column, steps: list, finish) -> Column:
        """Apply steps one after another; each lambda binds its input once, so the expression stays linear in size."""
        if not steps:
            return finish(x)
        return F.transform(F.array(steps[0](x)), lambda y: chained(y, steps[1:], finish))[0]

    qs = [1 << b for b in range(bits - 1, 0, -1)]
    steps = [lambda x, q=q, i=i: turn(x, q, i) for q in qs for i in range(n)]

    def prefix_xor(x: Column) -> Column:
        return F.transform(
            x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v))
        )

    def unmask(x: Column) -> Column:
        top = F.element_at(x, last + 1)
        t = F.lit(0)
        for q in qs:
            t = t.bitwiseXOR(F.when(top.bitwiseAND(F.lit(q)) != 0, F.lit(q - 1)).otherwise(F.lit(0)))
        return F.transform(x, lambda v: v.bitwiseXOR(t))

    def interleave(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                out = out * 2 + F.shiftright(x[i], b).bitwiseAND(F.lit(1))
        return out.cast("long")

    return chained(start, [*steps, prefix_xor, unmask], interleave)


def hilbert_rank(df: DataFrame, dims: list[Dim], tie: list[str], bits: int = 4, rows_per_bucket: int = 50_000) -> DataFrame:
    """Add ``curve`` (position), ``rank`` (gapless from 0 over all rows) and ``total`` (row count).

    ``df`` should be narrow and cheap to read again: it is read three times. Rows on
    one cell are ordered by a hash of the ``tie`` columns, then the columns; equal rows
    get consecutive ranks.
    """
    if bits * len(dims) > MAX_CELL_BITS:
        raise ValueError(f"bits * dims must be at most {MAX_CELL_BITS}")
    names = [f"_level{i}" for i in range(len(dims))]
    coded = df
    for name, d in zip(names, dims, strict=True):
        if d.kind == "log":
            coded = coded.withColumn(name, log_level(F.col(d.column), bits))
        else:
            levels = rank_levels(df, d.column, name, bits)
            coded = coded.join(levels, coded[d.column].eqNullSafe(levels[f"{name}_value"])).drop(f"{name}_value")
    coded = coded.withColumn("_hash", F.xxhash64(*[F.col(c) for c in tie]).bitwiseAND(F.lit(0xFFFFFFFF)))
    cells = (
        coded.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("curve", hilbert_index([F.col(c) for c in names], bits))
        .withColumn("_first", F.sum("_rows").over(Window.orderBy("curve")) - F.col("_rows"))
        .withColumn("total", F.sum("_rows").over(Window.partitionBy()))
        .withColumn("_buckets", F.ceil(F.col("_rows") / rows_per_bucket).cast("long"))
        .drop("_rows")
    )
    # at most 2**MAX_CELL_BITS rows of a few numbers; written, so that no filter on the curve is evaluated per input row
    cells = materialise(cells, "cells")
    placed = coded.join(F.broadcast(cells), names).withColumn("_bucket", F.shiftright(F.col("_hash") * F.col("_buckets"), 32))
    first = (
        placed.groupBy("curve", "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("curve").orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy("curve", "_bucket").orderBy("_hash", *tie)
    return (
        placed.withColumn("_place", F.row_number().over(inside))
        .join(first, ["curve", "_bucket"])
        .withColumn("rank", (F.col("_first") + F.col("_before") + F.col("_place") - 1).cast("long"))
        .drop("_hash", "_bucket", "_buckets", "_first", "_before", "_place", *names)
    )


def cut_runs(ranked: DataFrame, shards: int) -> DataFrame:
    """Cut the ranked rows into ``shards`` runs whose row counts differ by at most one: adds ``shard`` and ``slot``."""
    r, n = F.col("rank"), F.col("total")
    shard = F.expr(f"(rank * {shards}) div total")
    return ranked.withColumn("shard", shard.cast("int")).withColumn(
        "slot", (r - F.expr(f"(shard * total + {shards} - 1) div {shards}")).cast("long")
    )


def shard_documents(
    docs: DataFrame, shards: int = 24, bits: int = 4, rows_per_bucket: int = 50_000, dims: list[Dim] | None = None
) -> DataFrame:
    """Assign every document to a shard.

    Returns doc_id, size (UTF-8 bytes + 8; a null text has none), text_crc32 (null as empty), law ``rows``,
    shard, slot (gapless from 0 in each shard), grown_shard (null: defined for the ``key`` law only),
    curve, lang, source. Null ids, languages and sources are values like any other (null sorts first);
    repeated rows keep one slot each; an empty table gives no rows; other columns are not read.
    """
    dims = dims or [Dim("size", "log"), Dim("lang"), Dim("source")]
    narrow = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
            text_crc32(F.col("text")).alias("text_crc32"),
            "lang",
            "source",
        ),
        "hilbert",
    )
    ranked = hilbert_rank(narrow, dims, ["doc_id", "text_crc32"], bits, rows_per_bucket)
    return cut_runs(ranked, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "lang",
        "source",
    )


def prune_report(sharded: DataFrame) -> DataFrame:
    """Per shard the row count and the range of every dimension, as a reader would use them to skip files."""
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("size", "lang", "source") for f in (F.min, F.max)],
    )


def op2_hilbert_shards(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
