"""Merkle manifest of a table, with nested-interval labels.

Every row is a leaf; the leaves of a tree are numbered, and a node is labelled with the interval of leaf numbers that it
covers, so that an ancestor is a node whose interval contains another's, and a node's siblings are what remains of its
parent's interval without its own. Trees are built and read in bands of levels:

* upwards, the nodes of a band that lie in one interval of ``2 ** BAND`` units form a group (of bounded size), which gives all
  its inner nodes and its top, the unit of the next band;
* downwards, a group is joined with its ancestors by the bucket that contains its interval: with the path from its top to the
  root, one row for each group. Within the group, interval differences give the siblings of every unit.

So no group is larger than ``2 ** BAND`` rows, the shuffled rows of all bands together are little more than the leaves, and
the number of Spark jobs grows with the logarithm of the rows. The roots of the trees are the leaves of one more tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import held_out, materialise, table
from kiln.llm.ranks import number_rows

#: Levels of a band; a group has up to 2**BAND units.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UNIT = "tree string, idx bigint, n bigint, lo bigint, hi bigint, digest string"
NODE = "tree string, level int, lo bigint, hi bigint, digest string, n bigint, top boolean"
NODE_FIELDS = pa.schema(
    {"tree": pa.string(), "level": pa.int32(), "lo": pa.int64(), "hi": pa.int64(), "digest": pa.string(), "n": pa.int64(), "top": pa.bool_()}
)
PATH = "left array<string>, right array<string>, subroot string, root string"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(digests: list[str], most: int | None) -> Iterator[list[str]]:
    """The levels from the given one upwards: ``most`` more, or until one node remains."""
    yield digests
    while most is None and len(digests) > 1 or most:
        digests = [digest_of(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
        most = None if most is None else most - 1
        yield digests


def _sorted(group: pa.Table) -> pa.Table:
    return group.sort_by("idx").combine_chunks()


def _height(n: int) -> int | None:
    """Levels of a group in a band: all of them where the tree has several groups, else up to its root."""
    return BAND if n > 1 << BAND else None


def _inner_nodes(base: int) -> Callable[[pa.Table], pa.Table]:
    """From the units of a group, which are on the level ``base``, to its inner nodes; of a lone unit of a tree, to itself."""

    def up(group: pa.Table) -> pa.Table:
        group = _sorted(group)
        tree, n = group["tree"][0].as_py(), group["n"][0].as_py()
        lo, hi = group["lo"].to_pylist(), group["hi"].to_pylist()
        levels = list(levels_above(group["digest"].to_pylist(), _height(n)))
        rows = []
        for k, level in enumerate(levels):
            top = k == len(levels) - 1
            for i, digest in enumerate(level if k or top else []):
                last = min((i + 1) << k, len(lo)) - 1
                rows.append((tree, base + k, lo[i << k], hi[last], digest, -(-n >> BAND) if top else 0, top))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE_FIELDS, strict=True)], schema=NODE_FIELDS)

    return up


def climb(units: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """``units`` (UNIT; ``most``: the largest n) -> (the units of every band, the nodes made in every band)."""
    bands, made = [units], []
    for band in range(64 // BAND):
        groups = bands[-1].select("tree", "idx", "n", "lo", "hi", "digest").groupBy("tree", F.shiftright("idx", BAND))
        made.append(materialise(groups.applyInArrow(_inner_nodes(band * BAND), NODE), "nodes"))
        if most <= 1 << BAND:
            return bands, made
        most = -(-most >> BAND)
        unit = F.shiftright("lo", BAND * (band + 1))
        bands.append(made[-1].where("top AND n > 1").select("tree", unit.alias("idx"), "n", "lo", "hi", "digest"))
    raise ValueError("more leaves than a 64-bit number can count")


def tops(made: list[DataFrame]) -> DataFrame:
    """tree and its root's digest."""
    out = [nodes.where("top AND n = 1").select("tree", "digest") for nodes in made]
    return _union(out)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _paths(digests: list[str], n: int) -> tuple[list[list[str]], list[list[str]]]:
    """For every unit of a group, level by level, the digests of its siblings before and after it ('' where there are none)."""
    left, right = [[] for _ in digests], [[] for _ in digests]
    for k, level in enumerate(list(levels_above(digests, _height(n)))[:-1]):
        for u in range(len(digests)):
            own = u >> k
            first = own & ~1  # the parent's interval, of which the node's own is taken away
            left[u].append("".join(level[first:own]))
            right[u].append("".join(level[own + 1 : first + 2]))
    return left, right


def _with_ancestors(units: DataFrame, above: DataFrame, finish, schema: str) -> DataFrame:
    """Join every group of units with the path of its top (``above``: tree, chunk and PATH), and apply ``finish``.

    ``finish(group, left, right, subroot, root)`` gets the sorted group and the whole path of every unit.
    """

    def down(group: pa.Table, path: pa.Table) -> pa.Table:
        group, path = _sorted(group), path.to_pylist()[0]
        left, right = _paths(group["digest"].to_pylist(), group["n"][0].as_py())
        left, right = [x + path["left"] for x in left], [x + path["right"] for x in right]
        return finish(group, left, right, path["subroot"], path["root"])

    units = units.withColumn("chunk", F.shiftright("idx", BAND))
    return units.groupBy("tree", "chunk").cogroup(above.groupBy("tree", "chunk")).applyInArrow(down, schema)


def _as_chunks(group: pa.Table, left: list, right: list, subroot: str, root: str) -> pa.Table:
    n = len(group)
    paths = [pa.array(x, pa.list_(pa.string())) for x in (left, right)]
    names = ["tree", "chunk", "left", "right", "subroot", "root"]
    return pa.table([group["tree"], group["idx"], *paths, pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string())], names)


def descend(bands: list[DataFrame], above: DataFrame, finish, schema: str) -> DataFrame:
    """From the trees' own paths (``above``: tree and PATH) down to the leaves, to which ``finish`` is applied."""
    single = above.withColumn("chunk", F.lit(0).cast("bigint"))
    ended = F.col("n") <= 1 << BAND
    reached = None
    for band in range(len(bands) - 1, -1, -1):
        ends = single.join(bands[band].where(ended).select("tree").distinct(), "tree", "left_semi")
        reached = ends if reached is None else ends.unionByName(reached)
        if band == 0:
            return _with_ancestors(bands[0], reached, finish, schema)
        reached = materialise(_with_ancestors(bands[band], reached, _as_chunks, f"tree string, chunk bigint, {PATH}"), "paths")


def leaves_of(docs: DataFrame, fields: Sequence[str], tree: str, order: str, claimed: dict[str, Column] | None = None) -> DataFrame:
    """Numbered leaves: ``order``, tree (encoded), label (the tree's value), digest, claimed, and idx, n, lo, hi."""
    own = leaf_digest([F.col(f"`{c}`") for c in fields])
    other = own
    if claimed:
        same = F.lit(True)
        for c, value in claimed.items():
            same = same & F.col(f"`{c}`").eqNullSafe(value)
        other = F.when(same, own).otherwise(leaf_digest([claimed.get(c, F.col(f"`{c}`")) for c in fields]))
    rows = docs.select(
        F.col(f"`{order}`").alias("id"),
        encoded(F.col(f"`{tree}`")).alias("tree"),
        F.col(f"`{tree}`").cast("string").alias("label"),
        own.alias("digest"),
        other.alias("claimed"),
    )
    numbered = number_rows(materialise(rows, "leaves"), "tree", ["id", "digest", "claimed"])
    return materialise(numbered.withColumns({"lo": F.col("idx"), "hi": F.col("idx") + 1}), "leaves")


class Manifest:
    """The trees of ``docs``: one for every value of ``tree`` (null is a value), and one over their roots.

    A leaf is the digest of a row's ``fields``; leaves ascend by ``order`` (nulls first, equal ones by digest), trees by
    their value (null first, by UTF-8 bytes). ``claimed`` replaces fields by other values for :meth:`proofs`, which
    then checks the rows as claimed against the manifest of the rows as they are. Nulls, empty and long texts are
    ordinary values, repeated rows are leaves of their own, and columns outside ``fields`` are not read. An empty
    table has no trees and gives no rows.
    """

    def __init__(
        self,
        docs: DataFrame,
        fields: Sequence[str] = FIELDS,
        tree: str = "lang",
        order: str = "doc_id",
        claimed: dict[str, Column] | None = None,
    ):
        self.leaves = leaves_of(docs, fields, tree, order, claimed)
        self.bands, self.made = climb(self.leaves, self.leaves.agg(F.max("n")).first()[0] or 0)
        labels = self.leaves.where("idx = 0").select("tree", "label")
        roots = tops(self.made).join(labels, "tree").withColumnsRenamed({"tree": "value"}).withColumn("tree", F.lit(""))
        roots = number_rows(materialise(roots, "roots"), "tree", ["label"])
        roots = materialise(roots.withColumns({"lo": F.col("idx"), "hi": F.col("idx") + 1}), "roots")
        self.roots = roots
        self.top_bands, self.top_made = climb(roots, roots.agg(F.max("n")).first()[0] or 0)

    def nodes(self) -> DataFrame:
        """All nodes: tree ('' for the tree over the roots), level (0: leaves), lo, hi (leaf numbers covered, hi excluded), digest."""
        columns = ["tree", "level", "lo", "hi", "digest"]
        zero = F.lit(0).alias("level")
        leaves = [x.select("tree", zero, "lo", "hi", "digest") for x in (self.leaves, self.roots)]
        inner = [x.where("level > 0").select(*columns) for x in (*self.made, *self.top_made)]
        return _union([*leaves, *inner])

    def proofs(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256 (digest of all siblings up to the root), folded_root, verified; one row per leaf."""

        def tree_path(group, left, right, subroot, root):
            out = _as_chunks(group, left, right, "", root).drop_columns(["tree", "chunk", "subroot"])
            return out.add_column(0, "tree", group["value"]).add_column(3, "subroot", group["digest"])

        root = tops(self.top_made).select(
            "tree", F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"),
            F.lit("").alias("subroot"), F.col("digest").alias("root"),
        )
        above = materialise(descend(self.top_bands, root, tree_path, f"tree string, {PATH}"), "paths")

        def check(group, left, right, subroot, root):
            folded = []
            for digest, before, after in zip(group["claimed"].to_pylist(), left, right, strict=True):
                for a, b in zip(before, after, strict=True):
                    digest = digest_of(a, digest, b)
                folded.append(digest)
            proofs = [digest_of(*[x for pair in zip(a, b, strict=True) for x in pair]) for a, b in zip(left, right, strict=True)]
            n = len(group)
            texts = [[subroot] * n, [root] * n, proofs, folded]
            return pa.table(
                [group["id"], group["digest"], *[pa.array(x, pa.string()) for x in texts], pa.array([x == root for x in folded])],
                ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
            )

        kind = self.leaves.schema["id"].dataType.simpleString()
        schema = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return descend(self.bands, above, check, schema)


def op12_merkle_manifest(spark, sf_dir):
    """Proofs of all documents, of which those with a crc32 of the id divisible by 7 claim one character more."""
    more = F.when(held_out(F.col("doc_id"), 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    proofs = Manifest(table(spark, sf_dir, "documents"), claimed={"n_chars": more}).proofs()
    return proofs.withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])) AS state FROM documents, crc),
f AS (
  SELECT doc_id, lang, coalesce(strlen(lang) || ':' || lang, '-') AS tree,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') AS a, n_chars AS n, coalesce(strlen(text) || ':' || text, '-') AS b,
         n_chars + CASE WHEN xor(state, 4294967295::UBIGINT) % 7 = 0 THEN 1 ELSE 0 END AS m FROM d),
leaves AS (
  SELECT doc_id, lang, tree, sha256(a || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || b) AS leaf,
         sha256(a || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || b) AS claimed FROM f),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
up AS (
  SELECT tree, 0 AS level, i, leaf AS digest, n FROM ranked
  UNION ALL
  SELECT tree, min(level) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), min((n + 1) // 2) FROM up WHERE n > 1 GROUP BY tree, i // 2),
tops AS (SELECT tree, digest AS subroot FROM up WHERE n = 1),
trees AS (
  SELECT tree, subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM tops JOIN (SELECT DISTINCT tree, lang FROM leaves) USING (tree)),
up2 AS (
  SELECT 0 AS level, i, subroot AS digest, n FROM trees
  UNION ALL SELECT min(level) + 1, i // 2, sha256(string_agg(digest, '' ORDER BY i)), min((n + 1) // 2) FROM up2 WHERE n > 1 GROUP BY i // 2),
height AS (SELECT tree, max(level) AS h FROM up GROUP BY tree),
path AS (
  SELECT r.tree, r.i AS leaf_no, u.level, (r.i >> u.level) & 1 = 1 AS is_left, s.digest
  FROM ranked r JOIN up u ON u.tree = r.tree AND u.i = r.i >> u.level AND u.n > 1
  LEFT JOIN up s ON s.tree = u.tree AND s.level = u.level AND s.i = xor(u.i, 1)
  UNION ALL
  SELECT r.tree, r.i, h + u.level, (t.i >> u.level) & 1 = 1, s.digest
  FROM ranked r JOIN trees t USING (tree) JOIN height USING (tree) JOIN up2 u ON u.i = t.i >> u.level AND u.n > 1
  LEFT JOIN up2 s ON s.level = u.level AND s.i = xor(u.i, 1)),
proof AS (SELECT tree, leaf_no, sha256(string_agg(coalesce(digest, ''), '' ORDER BY level)) AS proof FROM path GROUP BY ALL),
fold AS (
  SELECT tree, i, 0 AS level, claimed AS cur FROM ranked
  UNION ALL
  SELECT f.tree, f.i, f.level + 1, sha256(CASE WHEN is_left THEN coalesce(digest, '') || cur ELSE cur || coalesce(digest, '') END)
  FROM fold f JOIN path p ON p.tree = f.tree AND p.leaf_no = f.i AND p.level = f.level),
folded AS (SELECT tree, i, arg_max(cur, level) AS folded_root FROM fold GROUP BY ALL)
SELECT doc_id, leaf, subroot, r.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM ranked JOIN tops USING (tree) JOIN folded USING (tree, i) LEFT JOIN proof ON proof.tree = ranked.tree AND leaf_no = ranked.i
CROSS JOIN (SELECT digest FROM up2 WHERE n = 1) r
"""
