"""Character n-grams inside words: hashes, counts by group of documents, and class-conditional models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialise, small_batches
from kiln.llm.scoring import texts_of
from kiln.llm.words import mix64, text_slices

_U = np.uint64
BEGIN, END = 2, 3
DISCOUNT = 0.75
#: Marks cut from both ends of a word that holds more than them.
EDGE = ".,;:!?\"()[]{}*#$%&|<>'=-_/\\«»“”„…"


def plain(word: bytes) -> str:
    """Lower case, without marks at the ends."""
    s = word.decode("utf-8", "replace").lower()
    return s.strip(EDGE) or s


def char_grams(words: list[str], most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Characters of the words, each word between BEGIN and END: (word number, place in the word, hashes by length).

    ``hashes[k][i]`` is of the k characters that end at i; it is meaningful where the place is at least k - 1.
    """
    joined = (chr(BEGIN) + f"{chr(END)}{chr(BEGIN)}".join(w.replace(chr(BEGIN), " ") for w in words) + chr(END)) if words else ""
    chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(_U)
    begins = chars == BEGIN
    at = np.arange(len(chars))
    place = at - np.maximum.accumulate(np.where(begins, at, 0)) if len(chars) else at
    hashes = [np.zeros(len(chars), _U)]
    for k in range(1, most + 1):
        h = np.zeros(len(chars), _U)
        own = (chars[: len(chars) - k + 1] + _U(1)) * _U(0x9E3779B97F4A7C15)
        h[k - 1 :] = mix64(hashes[-1][k - 1 :] * _U(3) + own)
        hashes.append(h)
    return np.cumsum(begins) - 1, place, hashes


def gram_counts(
    sample: DataFrame, groups: int, order: int, without: Sequence[Sequence[int]] = ()
) -> tuple[np.ndarray, ...]:
    """Documents that have each n-gram, by group: (length, hash, hash of its context, counts with a column per group).

    ``sample`` has text and group (0 to ``groups`` - 1) and is summed by Spark. All n-grams come to the driver: ``order`` for
    each letter of the sample at most, so the caller bounds the letters (:func:`share_of`).

    With ``without`` (sets of groups) two more arrays follow: whether the n-gram begins its word, and a column per set with the
    continuation counts: before how many different characters the n-gram was seen in the groups outside the set.
    """
    keys = ["k", "gram", "context", *(["suffix", "start"] if without else [])]
    names = [*keys, *[f"c{g}" for g in range(groups)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("group").to_pylist()
            for a, b, data, offsets in text_slices(batch.column("text")):
                seen: dict[str, np.ndarray] = {}
                for text, g in zip(texts_of(data, offsets), group[a:b], strict=True):
                    for w in {plain(w) for w in text.split()}:
                        seen.setdefault(w, np.zeros(groups, np.int64))[g] += 1
                word, place, hashes = char_grams(list(seen), order)
                weight = np.array(list(seen.values())).reshape(len(seen), groups)
                for k in range(1, order + 1):
                    at = np.flatnonzero(place >= max(k - 1, 1))
                    gram, one, back = np.unique(hashes[k][at], return_index=True, return_inverse=True)
                    sums = [np.bincount(back, weight[word[at], g], len(gram)).astype(np.int64) for g in range(groups)]
                    context = np.concatenate([hashes[0][:1], hashes[k - 1][:-1]])[at[one]]
                    columns = [np.full(len(gram), k, np.int32), gram.view(np.int64), context.view(np.int64)]
                    columns += [hashes[k - 1][at[one]].view(np.int64), place[at[one]] == k - 1] if without else []
                    columns += sums
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    schema = "k int, gram bigint, context bigint, " + ("suffix bigint, start boolean, " if without else "")
    schema += ", ".join(f"c{g} bigint" for g in range(groups))
    small_batches(sample.sparkSession)
    sums = sample.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names[len(keys) :]])
    kept = materialise(sums, "grams")
    if without:  # each longer n-gram is one more character before its suffix
        others = [[f"c{g}" for g in range(groups) if g not in gs] for gs in without]
        seen = [F.count_if(sum((F.col(c) for c in cs), F.lit(0)) > 0).alias(f"left{i}") for i, cs in enumerate(others)]
        left = kept.where("k > 1").groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(*seen)
        kept = kept.drop("suffix").join(left, ["k", "gram"], "left").fillna(0, [f"left{i}" for i in range(len(without))])
    got = kept.toArrow()
    gram, context = (got[c].to_numpy().view(np.uint64) for c in ("gram", "context"))
    out = got["k"].to_numpy(), gram, context, np.stack([got[c].to_numpy() for c in names[len(keys) :]], axis=1)
    if without:
        start = got["start"].to_numpy()
        out += start, np.stack([got[f"left{i}"].to_numpy() for i in range(len(without))], axis=1)
    return out


def share_of(rows: int, letters: int, most_rows: int, most_letters: int) -> float:
    """The share of a class's documents to learn from, so that about so many rows and letters at most are expected."""
    return min(1.0, most_rows / max(rows, 1), most_letters / max(letters, 1))


def kneser_ney(k: np.ndarray, counts: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Counts for ``CharModels`` by Kneser-Ney: those of the longest n-grams (of the full order, or from the word's beginning)
    are by class, all shorter ones have the same continuation counts in every class."""
    return np.where(((k < k.max(initial=1)) & ~start)[:, None], left[:, None], counts)


class CharModels:
    """Likelihoods of words under one character model per class (a column of ``counts``): interpolated
    absolute discounting over n-grams inside a word, as sorted arrays.

    Raw counts give plain absolute discounting, those of ``kneser_ney`` give Kneser-Ney with a back-off shared by the classes.
    """

    def __init__(self, k: np.ndarray, gram: np.ndarray, context: np.ndarray, counts: np.ndarray):
        self.classes, self.order, self.levels = counts.shape[1], int(k.max(initial=1)), []
        for level in range(1, self.order + 1):
            mine = (k == level) & (counts.sum(axis=1) > 0)
            at = np.argsort(gram[mine])
            g, x, c = gram[mine][at], context[mine][at], counts[mine][at].astype(np.float32)
            known, back = np.unique(x, return_inverse=True)
            facts = np.zeros((len(known), 2 * c.shape[1]), np.float32)  # sums and kinds of what follows the context
            np.add.at(facts, back, np.concatenate([c, c > 0], axis=1))
            self.levels.append((g, c, known, facts))

    @staticmethod
    def _find(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros((len(wanted), rows.shape[1]), np.float32)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((keys[at] == wanted)[:, None], rows[at], np.float32(0))

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        word, place, hashes = char_grams(words, self.order)
        p = np.full((len(word), self.classes), 0.5 / (len(self.levels[0][0]) + 1))
        for level, (keys, counts, known, facts) in enumerate(self.levels, 1):
            at = np.flatnonzero(place >= max(level - 1, 1))
            c = self._find(keys, counts, hashes[level][at]).astype(np.float64)
            f = self._find(known, facts, np.concatenate([hashes[0][:1], hashes[level - 1][:-1]])[at]).astype(np.float64)
            total, kinds = f[:, : c.shape[1]], f[:, c.shape[1] :]
            seen = np.maximum(total, 1)
            back = np.minimum(DISCOUNT * kinds / seen, 1) * p[at]
            p[at] = np.where(total > 0, np.maximum(c - DISCOUNT, 0) / seen + back, p[at])
        gain = np.log(p)
        gain[place == 0] = 0
        return np.stack([np.bincount(word, gain[:, j], len(words)) for j in range(self.classes)], axis=1)
