"""Scoring texts in Arrow batches: adds columns to a table and passes the others through."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kiln.llm.common import small_batches
from kiln.llm.words import Hasher, find_words, text_slices

#: Bytes of the words that a worker remembers, in each of two generations.
WORD_BYTES = 16 << 20
#: Bytes of new words that are computed at once: their characters take some hundred times as much for the moment.
FRESH_BYTES = 1 << 16

_kept: dict[str, Callable] = {}


def kept_scorer(key: str, make: Callable[[], Callable]) -> Callable:
    """The scorer of the model ``key``: made once in a worker process, which later tasks with the same model use again."""
    if key not in _kept:
        _kept.clear()  # one model at a time
        _kept[key] = make()
    return _kept[key]


def add_scores(docs: DataFrame, text: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Add the columns of ``schema`` (DDL), computed from ``text``; other columns pass through unchanged.

    ``make()`` runs once in every worker and gives a function of (bytes, offsets) of a slice of texts that returns one array for
    every new column. A column of ``docs`` that has the name of a new one is replaced. Null texts arrive empty.
    """
    small_batches(docs.sparkSession)
    new = StructType.fromDDL(schema)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in new.names])
    place, kinds, key = docs.columns.index(text), to_arrow_schema(new).types, uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(place)):
                score = score or kept_scorer(key, make)
                added = [pa.array(x, kind) for x, kind in zip(score(data, offsets), kinds, strict=True)]
                columns = [*batch.slice(a, b - a).columns, *added]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *new.names])

    return docs.mapInArrow(run, StructType(docs.schema.fields + new.fields))


class WordTable:
    """Numbers (one or several) of words, computed for each distinct word once: ``of(words)`` gives the rows.

    Words are remembered by 64-bit hashes, as sorted arrays, in two generations of about ``most`` bytes: when the younger is full it
    becomes the older, whose words come back when they occur again; the others are forgotten with it. Workers outlive
    stages, and several of them wait while few work, so what each holds has to be small.
    """

    #: Bytes of a word's entry besides its numbers.
    ENTRY = 8

    def __init__(self, width: int, compute: Callable[[list[bytes]], np.ndarray], most: int = WORD_BYTES):
        self.width, self.compute, self.most = width, compute, most
        self.place, self.rows = self.old_place, self.old_rows = np.zeros(0, np.uint64), np.zeros((0, width), np.float32)

    @property
    def bytes(self) -> int:
        return len(self.place) * (self.ENTRY + 4 * self.width)

    def _add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.place, keys)
        self.place, self.rows = np.insert(self.place, at, keys), np.insert(self.rows, at, rows, axis=0)

    @staticmethod
    def _find(place: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are in ``place``, and which of them are there."""
        if not len(place):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(place, keys), len(place) - 1)
        return at, place[at] == keys

    def _computed(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        rows = np.zeros((len(starts), self.width), np.float32)
        part = np.cumsum(ends - starts) // FRESH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(starts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            words = [raw[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            rows[a:b] = self.compute(words).reshape(b - a, self.width)
        return rows

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all words of the texts, and where each text's words begin (one more at the end)."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        w = find_words(data, np.cumsum([0, *map(len, texts)]))
        if not len(w.starts):
            return np.zeros((0, self.width), np.float32), w.first
        keys, one, back = np.unique(Hasher(data)(w.starts, w.ends), return_index=True, return_inverse=True)
        if self.bytes > self.most:
            self.old_place, self.old_rows = self.place, self.rows
            self.place, self.rows = self.place[:0].copy(), self.rows[:0].copy()
        rows = np.zeros((len(keys), self.width), np.float32)
        at, known = self._find(self.place, keys)
        rows[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            at, known = self._find(self.old_place, keys[new])
            rows[new[known]] = self.old_rows[at[known]]
            fresh = new[~known]
            if len(fresh):
                rows[fresh] = self._computed(raw, w.starts[one[fresh]], w.ends[one[fresh]])
            self._add(keys[new], rows[new])
        return rows[back], w.first


def texts_of(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
