"""Mixing sources to target weights by hash thresholds.

Each source has a budget of tokens (words). Whole documents are taken in the order
of a hash of their id, so the documents of a smaller budget are always among those
of a larger one. Instead of sorting, tokens are summed by (source, hash bucket), the
bucket in which the budget ends is found, and only that bucket is divided further,
until the boundary is one hash value. The result is one threshold per source, and
the selection is a filter on the hash.

A source holding a third of all rows collapses to at most ``2 ** 12`` sums per task
before any shuffle; no group of rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialise, table, word_count

#: Bits of the hash settled per refinement (32 in all).
LEVELS = (12, 10, 10)
#: Documents above this share of their source's size are settled first, so the rest can even out their error.
LARGE_SHARE = 0.01


def id_hash(doc_id: Column) -> Column:
    """32-bit hash of the id's decimal text: the first 8 hex digits of its MD5 (null id: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size).

    Sources by code point (null last) weigh the numbers of ``cycle``, repeating, and share
    ``share`` times all sizes; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight. That ends at ``min(most * size, level * weight)``
    with one common level, found here with running sums over the sources ordered by the
    level at which each one stops. One row per source.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (place % len(cycle)).cast("int") + 1)
    weighed = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    stops = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    all_rows = Window.partitionBy()
    level = (
        F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(stops), F.lit(0.0))
    ) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(stops), F.lit(0.0)))
    # the level rises from row to row as long as sources stop below it, then falls
    stepped = weighed.withColumn("_level", level).withColumn("_common", F.max("_level").over(all_rows))
    return stepped.select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("_cap"), F.col("_common") * F.col("weight")).alias("target"),
    )


def hash_thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the threshold under which its documents' sizes come nearest to its budget.

    ``docs`` has source, size and hash; ``budgets`` has source and budget. Returns source,
    threshold (documents with a smaller hash are taken) and taken (their sizes). Documents
    of one hash value are taken together. ``docs`` is read once per level, from the second on only
    the boundary bucket counts.
    """
    shift, state = 32, budgets.select(
        "source", F.col("budget").cast("double"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")
    )
    settled = None
    for bits in LEVELS:
        wider, shift = shift, shift - bits
        rows = docs.join(
            state.select(F.col("source").alias("_s"), "prefix", "budget", "below"),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright(F.col("hash"), wider) == F.col("prefix")),
        )
        sums = rows.groupBy("source", F.shiftright(F.col("hash"), shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        upto = F.col("below") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        placed = sums.withColumn("upto", upto)
        last = placed.groupBy("source").agg(
            F.first("budget").alias("budget"),
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", F.col("upto"), F.col("n")))).alias("cross"),
            F.max("upto").alias("all"),
        )
        last = materialise(last, "thresholds")
        # a budget that holds every document needs no boundary
        whole = last.where("cross IS NULL").select(
            "source", F.lit(1 << 32).cast("long").alias("threshold"), F.col("all").cast("long").alias("taken")
        )
        settled = whole if settled is None else settled.unionByName(whole)
        state = last.where("cross IS NOT NULL").select(
            "source",
            "budget",
            F.col("cross.bucket").alias("prefix"),
            (F.col("cross.upto") - F.col("cross.n")).alias("below"),
            F.col("cross.upto").alias("upto"),
        )
    with_it = F.col("below") + F.col("upto") <= 2 * F.col("budget")
    edge = state.select(
        "source",
        (F.col("prefix") + F.when(with_it, 1).otherwise(0)).cast("long").alias("threshold"),
        F.when(with_it, F.col("upto")).otherwise(F.col("below")).cast("long").alias("taken"),
    )
    return settled.unionByName(edge)


def mix_plan(sized: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source of ``sized`` (source, size, hash): source_size, target, passes (whole passes over its documents), and
    the hash thresholds under which large and other documents are taken once more.

    A source's target over its size gives the passes and a remainder; the remainder is filled by hash threshold, first with the
    documents above 1 % of the source (at most 100 a source), then with the others, which absorb most of the error
    the large ones leave. ``sized`` should be narrow: it is read several times.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = materialise(source_targets(sizes, cycle, share, float(most)), "targets")
    passes = F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))
    plan = targets.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, passes).otherwise(0).cast("long").alias("passes"),
    ).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("_s"))).withColumn("large", is_large())
    large, small = joined.where("large"), joined.where("NOT large")
    cols = ["source", "size", "hash"]
    of_large = large.groupBy("source").agg((F.sum("size") * F.first("rest") / F.first("source_size")).alias("budget"))
    first = materialise(hash_thresholds(large.select(*cols), of_large), "large").select(
        F.col("source").alias("_f"), F.col("threshold").alias("large_below"), "taken"
    )
    planned = materialise(plan.join(first, F.col("_s").eqNullSafe(F.col("_f")), "left").drop("_f"), "plan")
    rest = planned.select(
        F.col("_s").alias("source"),
        F.greatest(F.col("rest") - F.coalesce(F.col("taken"), F.lit(0)), F.lit(0.0)).alias("budget"),
    )
    second = materialise(hash_thresholds(small.select(*cols), rest), "small").select(
        F.col("source").alias("_f"), F.col("threshold").alias("small_below")
    )
    done = planned.join(second, F.col("_s").eqNullSafe(F.col("_f")), "left").drop("_f", "taken", "rest")
    return materialise(done, "mix-plan")


def is_large() -> Column:
    return F.col("size") > F.col("source_size") * LARGE_SHARE


def mix(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often the mix takes every document of ``docs`` (doc_id, source, text and any other columns).

    Adds size (words; null text 0), source_size, target and times (0 to ``most``; the words taken are size * times).
    Null sources form a source of their own; repeated rows are taken alike; an empty table stays
    empty; other columns pass through (columns of ``docs`` that have the name of a new one are replaced).
    """
    added = ["size", "source_size", "target", "times", "hash"]
    docs = docs.drop(*added)
    sized = docs.withColumns({"size": word_count(F.col("text")), "hash": id_hash(F.col("doc_id"))})
    plan = mix_plan(materialise(sized.select("source", "size", "hash"), "mix"), cycle, share, most)
    below = F.when(is_large(), F.col("large_below")).otherwise(F.col("small_below"))
    again = F.when(F.col("hash") < F.coalesce(below, F.lit(0)), 1).otherwise(0)
    chosen = sized.join(plan, F.col("source").eqNullSafe(F.col("_s")))
    return chosen.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "size",
        "source_size",
        "target",
        F.least(F.col("passes") + again, F.lit(most)).cast("long").alias("times"),
    )


def op9_mix_threshold(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    taken = (F.col("size") * F.col("times")).alias("taken")
    return mixed.select("doc_id", "size", "source", "source_size", "target", taken)


MIX_SQL = r"""
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS hash
  FROM {docs}),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS cap,
         ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER stops, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER stops, 0)) AS level
  FROM weighed
  WINDOW stops AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS passes FROM targets),
joined AS (
  SELECT s.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest, s.size > p.source_size * 0.01::DOUBLE AS large
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
big_budget AS (SELECT source, sum(size) * any_value(rest) / any_value(source_size) AS budget FROM joined WHERE large GROUP BY source),
big AS (
  SELECT j.source, j.hash, b.budget, sum(sum(j.size)) OVER (PARTITION BY j.source ORDER BY j.hash) AS upto, sum(j.size) AS n
  FROM joined j JOIN big_budget b ON j.source IS NOT DISTINCT FROM b.source WHERE large GROUP BY j.source, j.hash, b.budget),
big_in AS (SELECT source, hash, n FROM big WHERE upto <= budget OR (upto - n <= budget AND upto - n + upto <= 2 * budget)),
big_taken AS (SELECT source, sum(n) AS taken FROM big_in GROUP BY source),
small_budget AS (
  SELECT p.source, greatest(p.target - p.passes * p.source_size - coalesce(t.taken, 0), 0) AS budget
  FROM plan p LEFT JOIN big_taken t ON p.source IS NOT DISTINCT FROM t.source),
small AS (
  SELECT j.source, j.hash, b.budget, sum(sum(j.size)) OVER (PARTITION BY j.source ORDER BY j.hash) AS upto, sum(j.size) AS n
  FROM joined j JOIN small_budget b ON j.source IS NOT DISTINCT FROM b.source WHERE NOT large GROUP BY j.source, j.hash, b.budget),
small_in AS (SELECT source, hash, n FROM small WHERE upto <= budget OR (upto - n <= budget AND upto - n + upto <= 2 * budget)),
mixed AS (
  SELECT j.doc_id, j.size, j.source, j.source_size, j.target,
         (j.size * least(j.passes + CASE WHEN coalesce(b.hash, s.hash) IS NOT NULL THEN 1 ELSE 0 END, 2))::BIGINT AS taken
  FROM joined j
  LEFT JOIN big_in b ON j.large AND j.source IS NOT DISTINCT FROM b.source AND j.hash = b.hash
  LEFT JOIN small_in s ON NOT j.large AND j.source IS NOT DISTINCT FROM s.source AND j.hash = s.hash)
"""

ORACLE = "WITH" + MIX_SQL.replace("{docs}", "documents") + "SELECT * FROM mixed"
