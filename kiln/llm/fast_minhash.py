"""Near-duplicate documents by fast similarity sketching.

The sketch of a set fills ``T`` bins in rounds (Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching",
2017): in round i every element is hashed to one bin with a value between i and i + 1, and a bin keeps its
smallest value; rounds end as soon as no bin is empty, and from round T on round i fills bin i - T from all
elements, so that every bin fills after 2T rounds at the latest. Two sets agree in a bin with the
probability of their Jaccard similarity, with the concentration of independent draws, in time
O(size + T log T).

The sketch is cut into bands; documents that agree in a whole band are candidates. With 42 bands of 6 bins a
pair at the similarity 0.8 is missed with a probability of 3e-6, at 0.85 of 4e-9, and a pair at 0.2 is proposed with
0.3 %. Candidates are confirmed on their full sets.

Copies and large groups cost no quadratic work:

* documents with equal sets form one class and only its smallest id goes on;
* in every band bucket, members are compared with the bucket's smallest member, the pivot (as many pairs as members);
* components are found from the confirmed links, and only in buckets that still hold several components are members
  of different components considered, so no link that could join two components is lost. Of these pairs, those stay that
  their differences from the pivot allow (an exact bound) and that a second, longer sketch does not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import keep_ids, materialise, small_batches, table
from kiln.llm.components import connected_components
from kiln.llm.words import Hasher, find_words, lower_ascii, mix64, text_slices

BAND_ROWS, BANDS = 6, 42
T = BAND_ROWS * BANDS
#: Bins of the second sketch, of which one bit each is kept; two sets may be linked when no fewer bits agree than this many
#: standard deviations below the mean at the similarity asked for (one linked pair in 50 million lies below).
LONG_T, DEVIATIONS = 4096, 5.5
_U = np.uint64
_EMPTY = _U(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text of a slice: (hashes, first), those of text i at ``first[i]:first[i + 1]``, sorted.

    A text with fewer words than ``width`` has its whole word sequence as one shingle; without words none.
    """
    data = lower_ascii(data)
    w = find_words(data, offsets)
    h, doc, n = Hasher(data)(w.starts, w.ends), w.doc(), len(offsets) - 1
    counts = np.diff(w.first)
    m = max(len(h) - width + 1, 0)
    key = np.zeros(m, _U)
    for k in range(width):
        key = mix64(key + h[k : k + m] * _U(2 * k + 1))
    at = np.flatnonzero(doc[:m] == doc[width - 1 :]) if m else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    whole = np.zeros(len(short), _U)
    for j, i in enumerate(short.tolist()):
        x = np.zeros(1, _U)
        for k, p in enumerate(range(w.first[i], w.first[i + 1])):
            x = mix64(x + h[p : p + 1] * _U(2 * k + 1))
        whole[j] = mix64(x + _U(counts[i]))[0]
    of = np.concatenate([doc[at], short])
    key = np.concatenate([key[at], whole])
    order = np.lexsort((key, of))
    of, key = of[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    of, key = of[new], key[new]
    return key, np.searchsorted(of, np.arange(n + 1))


def sketch(key: np.ndarray, first: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches (rows: sets; t bins of 64-bit values) of the sets ``key[first[i]:first[i + 1]]``.

    Rows of empty sets stay empty (all bits set).
    """
    n = len(first) - 1
    sizes = np.diff(first)
    bins = np.full((n, t), _EMPTY, _U)
    flat = bins.reshape(-1)
    open_sets = np.flatnonzero(sizes > 0)
    if not len(open_sets):
        return bins
    of = np.repeat(np.arange(n), sizes)
    element, owner = key, of
    salts = mix64(np.arange(1, 2 * t + 1, dtype=_U))
    for i in range(2 * t):
        x = mix64(element ^ salts[i])
        value = (x & _U((1 << 44) - 1)) | _U(i << 44)
        if i < t:
            place = ((x >> _U(44)) * _U(t)) >> _U(20)
            np.minimum.at(flat, owner * t + place.astype(np.int64), value)
        else:
            np.minimum.at(flat, owner * t + (i - t), value)
        still = (bins[open_sets] == _EMPTY).any(axis=1)
        if not still.any():
            break
        if not still.all():
            open_sets = open_sets[still]
            active = np.zeros(n, bool)
            active[open_sets] = True
            keep = active[owner]
            element, owner = element[keep], owner[keep]
    return bins


def band_keys(bins: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per set and band."""
    cut = bins[:, : rows * bands].reshape(len(bins), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), cut.shape[:2])
    for k in range(rows):
        key = mix64(key + cut[:, :, k] * _U(2 * k + 1))
    return key


def one_bits(bins: np.ndarray) -> np.ndarray:
    """The lowest bit of each bin, in 64-bit words."""
    return np.packbits((bins & _U(1)).astype(np.uint8), axis=1).view(_U).reshape(len(bins), -1)


def least_bits(percent: int) -> int:
    """Bits of the second sketch that must agree."""
    p = (1 + percent / 100) / 2
    return int(LONG_T * p - DEVIATIONS * (LONG_T * p * (1 - p)) ** 0.5)


def _rows(values: np.ndarray, full: np.ndarray) -> pa.Array:
    """Rows of numbers as lists; rows outside ``full`` (booleans) are empty lists."""
    ends = np.concatenate([[0], np.cumsum(full * values.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1).view(np.int64)))


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (128 bits of the set, whatever its order), bands. Empty sets have no bands."""
    schema = "doc_id bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                key, first = shingle_sets(data, offsets, width)
                n = np.diff(first)
                sums = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix64(key ^ _U(salt)))])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                full = np.flatnonzero(n)
                keys = band_keys(sketch(key, np.concatenate([first[full], first[-1:]])))
                arrays = [batch.column(0).slice(a, b - a), pa.array(n), *map(pa.array, sums), _rows(keys, n > 0)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "s1", "s2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def long_bits(texts: DataFrame, width: int) -> DataFrame:
    """doc_id and the bits of the second sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), 1 << 17):
                key, first = shingle_sets(data, offsets, width)
                bits = one_bits(sketch(key, first, LONG_T))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _rows(bits, np.ones(b - a, bool))], ["id", "bits"])

    return texts.select("doc_id", "text").mapInArrow(run, "id bigint, bits array<bigint>")


def common_sizes(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """For pairs (u, v): ``both``, the size of the intersection of their full sets, and the sizes u_n and v_n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(0, len(batch), 64):
                sets = []
                for c in ("u_text", "v_text"):
                    for _, _, data, offsets in text_slices(batch.column(c).slice(row, 64)):
                        key, first = shingle_sets(data, offsets, width)
                        sets += [key[x:y] for x, y in zip(first[:-1], first[1:], strict=True)]
                half = len(sets) // 2
                for a, b in zip(sets[:half], sets[half:], strict=True):
                    found.append((len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            sizes = [pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *sizes], ["u", "v", "both", "u_n", "v_n"])

    of = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text"))
    joined = pairs.join(of("u"), "u").join(of("v"), "v").select("u", "v", "u_text", "v_text")
    return joined.mapInArrow(run, "u bigint, v bigint, both bigint, u_n bigint, v_n bigint")


def linked(percent: int) -> F.Column:
    return 100 * F.col("both") >= percent * (F.col("u_n") + F.col("v_n") - F.col("both"))


def sizes_allow(percent: int, u: str = "u_n", v: str = "v_n") -> F.Column:
    return 100 * F.least(u, v) >= percent * F.greatest(u, v)


def pivot_allows(percent: int, u: str = "u", v: str = "v") -> F.Column:
    """Whether two members of a bucket can reach the similarity, from what each lacks (``_less``) and adds (``_more``) to the pivot.

    The intersection is the pivot's size less what either lacks, plus what both lack or both add; the last two are bounded
    by the smaller of the two. Bounds may stand for what is not known: less may be too small, more too large.
    """
    most = F.col("pivot_n") - F.greatest(f"{u}_less", f"{v}_less") + F.least(f"{u}_more", f"{v}_more")
    return (100 + percent) * most >= percent * (F.col(f"{u}_n") + F.col(f"{v}_n"))


def unsettled(members: DataFrame, stars: DataFrame, measured: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The members of buckets that may be linked with a member of another component there: one row per id.

    Strangers are members outside the pivot's component; a bucket without any is settled. Else a stranger is compared with all,
    and a member of the pivot's component only if it can reach the similarity with some stranger: with one that would lack as
    little, add as much and be as small as any stranger of the bucket. Returns id, component, n and hits, an array (one
    entry per bucket, no more than there are bands) of key, pivot_n, less, more and stranger.
    """
    component = found.select("id", "component")
    of_pivot = component.select(F.col("id").alias("pivot"), F.col("component").alias("pivot_component"))
    both = measured.select(F.col("u").alias("pivot"), F.col("v").alias("id"), "both")
    own = F.coalesce("component", "id")
    info = stars.join(both, ["pivot", "id"], "left").join(component, "id", "left").join(of_pivot, "pivot", "left")
    info = info.select(
        "pivot", "pivot_n", "id", "n", own.alias("component"), (own != F.coalesce("pivot_component", "pivot")).alias("stranger"),
        # pairs whose sizes rule out a link were not measured
        F.coalesce(F.col("pivot_n") - F.col("both"), F.greatest(F.col("pivot_n") - F.col("n"), F.lit(0))).alias("less"),
        F.coalesce(F.col("n") - F.col("both"), F.col("n")).alias("more"),
    )
    rows = members.join(materialise(info, "star-info"), ["pivot", "pivot_n", "id", "n"])
    when = lambda c: F.when(F.col("stranger"), F.col(c))
    mixed = rows.groupBy("key").agg(
        F.min(when("less")).alias("any_less"), F.max(when("more")).alias("any_more"), F.min(when("n")).alias("any_n")
    ).where("any_n IS NOT NULL")
    able = pivot_allows(percent, "own", "any")
    kept = rows.withColumns({"own_less": F.col("less"), "own_more": F.col("more"), "own_n": F.col("n")}).join(
        mixed.withColumnRenamed("key", "in_key"), (F.col("key") == F.col("in_key")) & (F.col("stranger") | able)
    )
    hit = F.struct("key", "pivot_n", "less", "more", "stranger")
    return kept.groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.collect_list(hit).alias("hits"))


def pairs_between(rest: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (u, v) of different components that share a bucket and may be linked; each pair once."""
    wanted = rest.select(F.col("id").alias("doc_id"))
    bits = long_bits(texts.join(wanted, "doc_id", "left_semi"), width)
    wide = materialise(rest.join(bits, "id").join(classes.select("id", "bands"), "id"), "unsettled")
    wide = wide.withColumn("hit", F.explode("hits")).select("id", "component", "n", "bits", "bands", "hit.*")

    def side(c: str) -> DataFrame:
        names = {"id": c, "component": f"{c}_in", "n": f"{c}_n", "less": f"{c}_less", "more": f"{c}_more", "bits": f"{c}_bits",
                 "bands": f"{c}_bands", "stranger": f"{c}_stranger"}
        return wide.select("key", *[F.col(k).alias(v) for k, v in names.items()], *(["pivot_n"] if c == "u" else []))

    apart = (F.col("u") < F.col("v")) & (F.col("u_in") != F.col("v_in")) & (F.col("u_stranger") | F.col("v_stranger"))
    allowed = sizes_allow(percent) & pivot_allows(percent) & sketches_allow(percent)
    # a pair comes out of one bucket only; if one of the two is the pivot there, it has been compared already
    here = F.array_min(F.array_intersect("u_bands", "v_bands")) == F.col("key")
    return side("u").join(side("v"), "key").where(apart & allowed & here).select("u", "v").distinct()


def sketches_allow(percent: int) -> F.Column:
    words = range(LONG_T // 64)
    differ = sum((F.bit_count(F.col("u_bits")[k].bitwiseXOR(F.col("v_bits")[k])) for k in words), start=F.lit(0))
    return LONG_T - differ >= least_bits(percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Group near-duplicate documents of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A-Z lower-cased; a document's set are its distinct ``width``-word shingles (its
    whole sequence when it has fewer words). Documents are linked when 100 * intersection >= percent * union.
    Returns doc_id, n_shingles, component_id (the smallest id reachable over links, itself included) and
    kept (doc_id = component_id), one row per row of ``docs``. Null texts and texts without words have an
    empty set and no link. Rows of one id count as one document; a null id is kept with a null component;
    an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    marked = materialise(sketch_documents(docs, width), "sketches")
    classes = (
        marked.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("s1", "s2", "n")
        .agg(F.min(F.struct("doc_id", "bands")).alias("r"))
        .select("s1", "s2", "n", F.col("r.doc_id").alias("id"), F.col("r.bands").alias("bands"))
    )
    classes = materialise(classes, "classes")
    spread = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min(F.struct("id", "n")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = shared.select("key", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n"))
    members = materialise(spread.join(shared, "key").where("id <> pivot"), "members")
    stars = materialise(members.select("pivot", "pivot_n", "id", "n").distinct(), "stars")
    involved = stars.select(F.col("id").alias("doc_id")).unionByName(stars.select(F.col("pivot").alias("doc_id")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = materialise(keep_ids(texts, involved, "doc_id"), "texts")
    likely = stars.where(sizes_allow(percent, "pivot_n", "n")).select(F.col("pivot").alias("u"), F.col("id").alias("v"))
    measured = materialise(common_sizes(likely, texts, width), "measured")
    found = materialise(connected_components(measured.where(linked(percent)).select("u", "v")), "components")
    rest = materialise(unsettled(members, stars, measured, found, percent), "rest")
    across = pairs_between(rest, classes, texts, width, percent)
    more = materialise(common_sizes(across, texts, width), "across").where(linked(percent)).select("u", "v")
    if more.isEmpty():
        final = found
    else:
        final = materialise(
            connected_components(found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)), "components"
        )
    named = classes.select("s1", "s2", "n", "id").join(final, "id", "left")
    named = named.select("s1", "s2", "n", F.coalesce("component", "id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return (
        marked.select("doc_id", "n", "s1", "s2")
        .join(named, ["s1", "s2", "n"], "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        )
    )


def op5_fast_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) >= 2 THEN words[i] || ' ' || words[i + 1] ELSE words[1] END AS shingle FROM places),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
steps AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u AS id, v AS other FROM steps UNION SELECT r.id, t.v FROM reach r JOIN steps t ON r.other = t.u),
least_id AS (SELECT id, min(other) AS other FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.other, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(l.other, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id l ON l.id = w.doc_id
"""
