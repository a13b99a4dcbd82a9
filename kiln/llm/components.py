"""Connected components of links, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialise

#: A node is hot with more edges than this, or than a ``HOT_SHARE``-th of all edges if that is more: so the hot nodes that are
#: broadcast are at most twice as many as ``HOT_SHARE``, however many edges there are.
HOT, HOT_SHARE = 100, 100_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_low(edges: DataFrame, low: DataFrame, hot: int) -> DataFrame:
    """Join every edge with its node's ``m``; ``low`` has one row per node, with its number of edges ``n``.

    The few nodes with more than ``hot`` edges are broadcast, so that their edges are not gathered in one task.
    """
    few = F.broadcast(low.where(F.col("n") > hot).select("u", F.col("m").alias("hot_m")))
    marked = edges.join(few, "u", "left")
    cold = marked.where("hot_m IS NULL").select("u", "v").join(low.where(F.col("n") <= hot).select("u", "m"), "u")
    return marked.where("hot_m IS NOT NULL").select("u", "v", F.col("hot_m").alias("m")).unionByName(cold)


def _large_star(edges: DataFrame, hot: int) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest in the node's neighbourhood."""
    both = _both(edges)
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_low(both.where("v > u"), low, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot: int) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them; ``edges`` has u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n"))
    moved = _with_low(edges, low, hot).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has u and v. Returns id and component (the smallest id reachable) for every id that is linked.

    Alternates the two star operations (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014) until the edges stop changing; the rounds grow with the logarithm of the longest chain. Every
    round is written to the shared folder. Only three numbers a round reach the driver. Links of a row with
    itself and null ends are ignored.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, seen = materialise(edges, "edges"), None
    while True:
        # equal sets of edges: by their number and 128 bits
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64(F.lit(1), "v", "u"))).first()
        if not state[0] or state == seen:
            break
        seen = state
        hot = max(HOT, state[0] // HOT_SHARE)
        edges = materialise(_small_star(_large_star(edges, hot), hot), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component"))
    ).distinct()
