"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the centred, PCA-aligned vectors is learned that brings them close to the corners of the binary cube (Gong and
Lazebnik, "Iterative Quantization", 2011); the signs of the rotated vector are its code, whose bits are balanced. The code is
cut into substrings, one hash table each (Norouzi et al., "Multi-Index Hashing", 2012): two vectors with the same label that
agree in a whole substring are candidates, and the original vectors decide. As long as their codes differ in fewer bits than
there are substrings, a pair is found for certain; several rotations give as many substrings as a pair at the threshold needs to
be found with a probability of 1 - ``MISS``, measured on the fitted rows.

What keeps it linear and whole:

* vectors that are equal form one class, counted by its size, and only its smallest id is coded;
* substrings are as long as the logarithm of the largest label's size, so a bucket of unrelated vectors stays small;
* a bucket larger than ``BLOCK`` is divided into parts, and each pair of parts is one group, so no task holds more than
  two parts at a time; a pair counts in the first table that it shares, so nothing is counted twice;
* groups give every vector's number of links and one link to the smallest id reached, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from kiln.llm.common import materialise, small_batches, table
from kiln.llm.components import connected_components

#: The rotations are fitted on at most this many vectors (those with the smallest hash of their id); all are coded.
FIT_ROWS = 4096
ROUNDS = 50
#: Bits that one rotation gives at most, and the probability with which a pair at the threshold may be missed.
CODE_BITS = 64
MISS = 1e-5
BLOCK = 1024


@dataclass
class Codes:
    """A fitted quantiser: ``keys(x)`` gives the substrings (rows: vectors, columns: tables) as numbers."""

    mean: np.ndarray
    planes: np.ndarray
    bits: int
    tables: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        ones = (unit(x) - self.mean) @ self.planes > 0
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        return ones.reshape(len(x), self.tables, self.bits) @ weights


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation that ``rounds`` alternations between codes and an orthogonal fit reach from a random start."""
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds if len(x) else 0):
        u, _, vt = np.linalg.svd(x.T @ np.where(x @ rotation > 0, 1.0, -1.0))
        rotation = u @ vt
    return rotation


def fit_codes(sample: np.ndarray, width: int, bits: int, cosine: float, miss: float = MISS, seed: int = 7) -> Codes:
    """Learn rotations on ``sample`` (rows of ``width`` numbers) and as many tables of ``bits`` bits as ``miss`` asks for.

    The share of tables in which a pair at ``cosine`` agrees is measured on sample rows and copies of them moved
    by that angle in a random direction (an unrelated start for each copy); with no rows, the angle's share of a half turn
    is taken.
    """
    rng = np.random.default_rng(seed)
    x = unit(sample.astype(np.float64)) if len(sample) else np.zeros((0, width))
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    axes = np.linalg.eigh((x - mean).T @ (x - mean) + 1e-12 * np.eye(width))[1][:, ::-1][:, : min(width, CODE_BITS)]
    rotated = lambda: axes @ learn_rotation((x - mean) @ axes, rng)
    planes = rotated()
    agree = 1 - math.acos(cosine) / math.pi
    if len(x):
        aside = rng.standard_normal(x.shape)
        aside = unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
        moved = cosine * x + math.sqrt(1 - cosine * cosine) * aside
        same = ((x - mean) @ planes > 0) == ((moved - mean) @ planes > 0)
        cut = max(1, same.shape[1] // bits)
        if same.shape[1] >= bits:
            agree = max(same[:, : cut * bits].reshape(len(x), cut, bits).all(axis=2).mean(), 1e-4) ** (1 / bits)
    tables = max(1, math.ceil(math.log(miss) / math.log1p(-min(agree**bits, 1 - 1e-9))))
    while planes.shape[1] < bits * tables:
        planes = np.concatenate([planes, rotated()], axis=1)
    return Codes(mean, planes[:, : bits * tables], bits, tables)


def dense(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of double-precision numbers, shorter vectors filled with zeros; scaled by powers of two, which no cosine feels."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets = np.asarray(vectors.offsets)
    values = np.asarray(vectors.values[offsets[0] : offsets[-1]], dtype=np.float64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < np.diff(offsets)[:, None]] = values
    top = np.abs(out).max(axis=1, initial=0)
    return np.ldexp(out, -np.frexp(top)[1][:, None])


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can be linked: it and its label are there, all components are finite, one at least is not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def with_keys(classes: DataFrame, codes: Codes) -> DataFrame:
    """Add ``keys``, those of the tables."""
    width, place = len(codes.mean), classes.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = codes.keys(dense(batch.column(place), width)).reshape(-1)
            ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * codes.tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(keys))], [*batch.schema.names, "keys"])

    return classes.mapInArrow(run, StructType([*classes.schema.fields, StructField("keys", ArrayType(LongType()))]))


def linked_pairs(x: np.ndarray, run_ends: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of rows in the same run whose cosine is large enough; ``run_ends``: for every row, the end of its run."""
    norm = np.sqrt((x * x).sum(axis=1))
    at = np.arange(len(x))
    step = 1
    while len(at := at[at + step < run_ends[at]]):
        for part in np.array_split(at, -(-len(at) // 8192)):
            cos = (x[part] * x[part + step]).sum(axis=1) / (norm[part] * norm[part + step])
            near = part[cos >= cosine]
            yield near, near + step
        step += 1


def _smallest(n: int, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest id that it reaches over the pairs (a, b)."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            return low


def links_in_groups(rows: DataFrame, width: int, cosine: float) -> DataFrame:
    """``rows``: partitioned and sorted by ``run``. 

    Returns place, id, links (rows of the classes linked) and root (the smallest id reached).
    """

    def measure(t: pa.Table) -> pa.RecordBatch:
        run = t["run"].to_numpy()
        x = dense(t["vector"], width)
        starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        ends = np.concatenate([starts[1:], [len(run)]])
        run_ends = np.repeat(ends, ends - starts)
        keys = t["keys"].combine_chunks().values.to_numpy().reshape(len(t), -1)
        label = t["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        number = {c: t[c].to_numpy() for c in ("place", "id", "d", "at", "i", "j", "part", "size")}
        found_a, found_b = [], []
        for a, b in linked_pairs(x, run_ends, cosine):
            ok = (label[a] == label[b]) & (number["d"][a] == number["d"][b]) & (number["at"][a] == number["at"][b])
            ok &= (number["i"][a] == number["i"][b]) & (number["j"][a] == number["j"][b])
            ok &= (number["i"][a] == number["j"][a]) | (number["part"][a] != number["part"][b])
            a, b = a[ok], b[ok]
            first = (keys[a] == keys[b]).argmax(axis=1) == number["at"][a] if len(a) else np.zeros(0, bool)
            same = keys[a, number["at"][a]] == keys[b, number["at"][b]]
            found_a.append(a[first & same])
            found_b.append(b[first & same])
        a, b = (np.concatenate([np.zeros(0, np.int64), *f]) for f in (found_a, found_b))
        links = np.bincount(a, number["size"][b], len(t)) + np.bincount(b, number["size"][a], len(t))
        root = _smallest(len(t), a, b, number["id"])
        has = np.flatnonzero(links)
        found = (number["place"][has], number["id"][has], links[has].astype(np.int64), root[has])
        return pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["place", "id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += len(batch)
            if n >= 8 * BLOCK:
                t = pa.Table.from_batches(kept)
                last = t["run"][-1].as_py()
                cut = int(np.searchsorted(t["run"].to_numpy(), last))
                if cut:
                    yield measure(t.slice(0, cut))
                kept = t.slice(cut).to_batches()
                n = len(t) - cut
        if n:
            yield measure(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "place bigint, id bigint, links bigint, root bigint")


def near_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, miss: float = MISS
) -> DataFrame:
    """Link the vectors of equal labels whose cosine (in double precision) is ``cosine`` at least.

    Returns, for every row, vec_id, n_links (rows linked directly), component_id (the smallest id reachable, itself included)
    and kept (vec_id = component_id). Null labels, null, empty and zero vectors and those with null or non-finite components
    are linked with nothing, as are rows without an id (their component is null, and they are kept). Vectors of different
    lengths are not linked. Rows of one id are vectors of their own in one component; extra columns are not read; an
    empty table gives no rows. A pair at the threshold is missed with the probability ``miss``, nearer ones with less;
    equal vectors are always linked.
    """
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{vector}`").alias("vector"),
    )
    good = rows.where(usable(F.col("vector"), F.col("label")) & F.col("vec_id").isNotNull())
    classes = good.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("size"))
    # a repeated id can stand for several classes, so each has a place
    classes = materialise(classes.withColumns({"d": F.size("vector"), "place": F.monotonically_increasing_id()}), "vectors")
    width, most = classes.groupBy("label").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("c")).agg(F.max("d"), F.max("c")).first()
    sample = classes.orderBy(F.xxhash64("id"), "id", "place").limit(FIT_ROWS).select("vector").toArrow()
    bits = max(8, math.ceil(math.log2(most or 1)))
    codes = fit_codes(dense(sample["vector"], width or 1), width or 1, bits, cosine, miss)

    coded = materialise(with_keys(classes, codes), "codes")
    bucket = ["label", "d", "at", "key"]
    spread = coded.select("place", "label", "d", F.posexplode("keys").alias("at", "key"))
    shared = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    members = spread.join(shared, bucket).withColumn("part", F.pmod(F.xxhash64("place"), parts).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    i, j = F.least("part", "other"), F.greatest("part", "other")
    members = members.select("place", "at", "part", i.alias("i"), j.alias("j"), F.xxhash64(*bucket, i, j).alias("run"))
    rows_of = members.join(coded, "place").repartition("run").sortWithinPartitions("run")
    found = materialise(links_in_groups(rows_of, width or 1, cosine), "links")

    links = found.groupBy("place").agg(F.sum("links").alias("links"))
    edges = found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")).distinct()
    named = (
        classes.join(links, "place", "left")
        .join(connected_components(edges), "id", "left")
        .select(
            "label", "vector",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(named, ["label", "vector"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op13_itq_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
good AS (
  SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS size FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.98),
reach AS (SELECT u AS id, v AS other FROM links UNION SELECT r.id, l.v FROM reach r JOIN links l ON r.other = l.u),
least_id AS (SELECT id, min(other) AS other FROM reach GROUP BY id),
n AS (SELECT u AS id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(l.other, vec_id)) AS component_id,
       vec_id <= coalesce(l.other, vec_id) AS kept
FROM v LEFT JOIN n ON n.id = vec_id LEFT JOIN least_id l ON l.id = vec_id
"""
