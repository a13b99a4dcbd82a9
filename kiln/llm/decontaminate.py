"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``PASSAGE`` words, and documents are seen through windows of 32 and 64
words every 16 words. Passages and windows are TF-IDF vectors over the words of the benchmark; words outside it
count only for the length of a window's vector. A randomised SVD (subspace iteration, Halko, Martinsson and Tropp 2011)
of the benchmark's passages and of the passages of all documents gives the latent space. Windows whose latent cosine with a
passage reaches ``COSINE`` are candidates, and a candidate is confirmed by the longest common subsequence
of words and by the passage's answer (its last words).

Windows are longer than short passages, and common words weigh little, so an exact copy may have a small cosine. Every exact
copy is therefore found besides, whatever its cosine: wherever a passage's rarest word occurs, the run of words around it is
compared with the passage.

What grows with the corpus is summed or filtered by Spark: document frequencies and the Gram matrix of the passages (words by
words) are summed over all documents, every window of every document is compared, and nothing is joined. Benchmark passages are handled in blocks of at most
``BLOCK``, so the model that every worker gets is bounded (``BLOCK * PASSAGE`` words by ``RANK`` numbers).

The projection of a window and its product with a passage are sums over words, so both are taken from one table of words by
passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialise, small_batches, table
from kiln.llm.scoring import add_scores
from kiln.llm.words import NOT_ALNUM, Hasher, RangeHasher, find_words, fold_case, text_slices

PASSAGE = 64
STEP = 16
#: Windows, in steps.
SCALES = (2, 4)
COSINE = 0.2
#: Benchmark passages in one latent space, its dimensions, and the extra dimensions of the iteration.
BLOCK, RANK, EXTRA = 256, 320, 16
ROUNDS = 2
#: Cells of the Gram matrix that a worker sums at a time (8 bytes each): more words than 4096 take several passes.
CELLS = 1 << 24
#: Products of pairs of words that are formed at once.
PAIRS = 1 << 17
#: Share of a passage's words that must be found in order, alone or with the share of its answer.
LCS_ALONE, LCS_WITH, ANSWER = 0.8, 0.6, 0.75
SHORT = 8
SLICE = 1 << 18


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower case) and where each text's words begin."""
    data = fold_case(data)
    w = find_words(data, offsets, NOT_ALNUM)
    return Hasher(data)(w.starts, w.ends), w.first


class Vocabulary:
    """Numbers of known word hashes by a direct table; unknown words get -1."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = max(12, int(len(self.hashes) * 8).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(self.hashes)
        self.table[slot] = np.arange(len(self.hashes))
        self.clash = np.unique(slot[self.table[slot] != np.arange(len(self.hashes))])  # slots of several words
        self.clashing = np.zeros(1 << self.bits, bool)
        self.clashing[self.clash] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = self._slot(h)
        got = self.table[slot]
        got = np.where((got >= 0) & (self.hashes[got] == h), got, -1)
        unsure = np.flatnonzero((got < 0) & self.clashing[slot])
        if len(unsure):
            at = np.minimum(np.searchsorted(self.hashes, h[unsure]), len(self.hashes) - 1)
            got[unsure] = np.where(self.hashes[at] == h[unsure], at, -1)
        return got


def lcs(pattern: dict[int, int], size: int, words: list[int], least: int = 0) -> int:
    """Length of the longest common subsequence, bit-parallel: ``pattern`` has a word's places in the passage as bits.

    0 when fewer than ``least`` of the words occur in the passage at all.
    """
    hits = list(filter(None, map(pattern.get, words)))
    if len(hits) < least:
        return 0
    v = full = (1 << size) - 1
    for m in hits:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Passage:
    """A passage of a benchmark item, ready for comparisons."""

    def __init__(self, item: int, words: np.ndarray):
        self.item, self.words = item, words.tolist()
        self.size = len(self.words)
        self.answer_size = max(1, self.size // 4)
        self.places, self.answer = self._places(self.words), self._places(self.words[-self.answer_size :])

    @staticmethod
    def _places(words: list[int]) -> dict[int, int]:
        out: dict[int, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def confirm(self, words: list[int]) -> tuple[float, float, bool]:
        """Shares of the passage and of its answer found in order in a region, and whether they confirm a leak.

        Passages under ``SHORT`` words must occur as they are.
        """
        whole = lcs(self.places, self.size, words, int(LCS_WITH * self.size)) / self.size
        if self.size < SHORT:
            same = any(words[i : i + self.size] == self.words for i in range(len(words) - self.size + 1)) if whole == 1 else False
            return whole, float(same), same
        if whole < LCS_WITH:
            return whole, 0.0, False
        answer = lcs(self.answer, self.answer_size, words) / self.answer_size
        return whole, answer, whole >= LCS_ALONE or answer >= ANSWER


def read_passages(benchmark: DataFrame) -> list[Passage]:
    """The benchmark's passages: items in nearly equal parts of at most ``PASSAGE`` words. Items without words have none."""
    out = []
    got = benchmark.select("item_id", "text").toArrow()
    for a, _, data, offsets in text_slices(got["text"].combine_chunks() if len(got) else pa.array([], pa.string())):
        h, first = word_hashes(data, offsets)
        for i in range(len(first) - 1):
            words = h[first[i] : first[i + 1]]
            for part in np.array_split(words, -(-len(words) // PASSAGE)) if len(words) else []:
                out.append(Passage(got["item_id"][a + i].as_py(), part))
    return out


def document_frequencies(docs: DataFrame, words: Vocabulary) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and the number of documents: over all documents, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n, size = np.zeros(len(words.hashes), np.int64), 0, len(words.hashes)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(0), SLICE):
                h, first = word_hashes(data, offsets)
                found = words.find(h)
                doc = np.repeat(np.arange(b - a), np.diff(first))
                pairs = np.unique((doc * size + found)[found >= 0])
                seen += np.bincount(pairs % size, minlength=size)
                n += b - a
        some = np.flatnonzero(seen)
        word, count = np.append(some, -1), np.append(seen[some], n)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(count)], ["word", "n"])

    got = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(len(words.hashes), np.int64), 0
    for w, n in zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True):
        if w < 0:
            total = n
        else:
            out[w] = n
    return out, total


def rows_of(found: np.ndarray, cuts: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit TF-IDF vectors (word numbers, weights) of the word ranges between ``cuts``."""
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        known = found[a:b]
        word, n = np.unique(known[known >= 0], return_counts=True)
        if len(word):
            weight = (1 + np.log(n)) * idf[word]
            yield word.astype(np.int32), (weight / max(np.linalg.norm(weight), 1e-9)).astype(np.float32)


#: Maps Arrow batches in a worker.
BatchMap = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
ROWS = "word array<int>, weight array<float>"


def passage_rows(words: Vocabulary, idf: np.ndarray) -> BatchMap:
    """Turns texts into unit TF-IDF vectors of their passages, words ascending; passages without known words have none."""
    size = len(words.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                h, first = word_hashes(data, offsets)
                found, n = words.find(h), np.diff(first)
                begin = np.concatenate([[0], np.cumsum(-(-n // PASSAGE))])
                passage = np.repeat(begin[:-1], n) + (np.arange(len(h)) - np.repeat(first[:-1], n)) // PASSAGE
                known = found >= 0
                key, count = np.unique(passage[known] * size + found[known], return_counts=True)
                of, word = np.divmod(key, size)
                weight = (1 + np.log(count)) * idf[word]
                length = np.sqrt(np.bincount(of, weight**2, begin[-1]))
                weight = weight / np.maximum(length[of], 1e-9)
                ends = pa.array(np.flatnonzero(np.diff(of, prepend=-1, append=-1)).astype(np.int32) if len(of) else np.zeros(1, np.int32))
                columns = [pa.array(word.astype(np.int32)), pa.array(weight.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in columns], ["word", "weight"])

    return run


def corpus_rows(docs: DataFrame, words: Vocabulary, idf: np.ndarray) -> DataFrame:
    """The :func:`passage_rows` of all documents."""
    return docs.select("text").mapInArrow(passage_rows(words, idf), ROWS)


def _gram(rows: list[tuple[np.ndarray, np.ndarray]], basis: np.ndarray, small: bool) -> np.ndarray:
    """A^T (A basis), or with ``small`` (A basis)^T (A basis), of sparse rows."""
    out = np.zeros((basis.shape[1],) * 2 if small else basis.shape)
    for k in range(0, len(rows), 256):
        part = rows[k : k + 256]
        word = np.concatenate([r[0] for r in part])
        weight = np.concatenate([r[1] for r in part]).astype(np.float64)
        begin = np.concatenate([[0], np.cumsum([len(r[0]) for r in part])[:-1]])
        y = np.add.reduceat(basis[word] * weight[:, None], begin, axis=0)
        if small:
            out += y.T @ y
        else:
            of = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.diff(word[order], prepend=-1))
            out[word[order][first]] += np.add.reduceat(y[of[order]] * weight[order, None], first, axis=0)
    return out


def line_places(low: int, high: int, size: int) -> np.ndarray:
    """The upper half of the lines from ``low`` to ``high`` of a matrix of ``size`` columns, packed: cell (i, j), i <= j, is at
    ``places[i] + j``; of other lines that is negative."""
    places = np.full(size, -2 * size, np.int64)
    kept = np.arange(low, high)
    places[low:high] = np.cumsum(size - kept) - size
    return places


def add_pairs(out: np.ndarray, places: np.ndarray, word: np.ndarray, weight: np.ndarray, first: np.ndarray) -> None:
    """Add every row's weight * weight of pairs of words (i, j), i <= j, to ``out``, cells at :func:`line_places`.

    Row r has the ascending words ``word[first[r]:first[r + 1]]``. Rows of equal length are taken together.
    """
    n = np.diff(first)
    for k in np.unique(n[n > 0]).tolist():
        i, j = np.triu_indices(k)
        starts = first[:-1][n == k]
        step = max(1, PAIRS // len(i))
        for a in range(0, len(starts), step):
            at = starts[a : a + step, None] + np.arange(k)
            w, x = word[at], weight[at]
            cell = places[w].take(i, 1) + w.take(j, 1)
            sums = x.take(i, 1) * x.take(j, 1)
            if (places < -len(places)).any():
                inside = cell >= 0
                cell, sums = cell[inside], sums[inside]
            np.add.at(out, cell.ravel(), sums.ravel())


def gram_matrix(rows: DataFrame, size: int, make: BatchMap | None = None) -> DataFrame:
    """The upper half of the Gram matrix (words by words, ``size`` each) of all ``rows`` (word, weight; words ascending), in lines.

    With ``make``, ``rows`` are what it makes the rows of; it runs in the worker that sums them, as a map of its own would
    start a second worker for every task, and workers stay for the stages after this one.

    Returns part (number of the first line), sums (lines of 32-bit floats) and own (sum of the diagonal there). Each task sums
    its rows in the upper half of a matrix of at most ``CELLS`` cells and there are no more tasks than cores, so what is
    shuffled follows the cores and the benchmark's words, not the corpus. More words take one pass for every ``CELLS`` cells.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    height, deep = min(size, max(1, CELLS // size)), max(1, (1 << 16) // size)
    if height < size:
        rows, make = materialise(rows.mapInArrow(make, ROWS) if make else rows, "passages"), None
    kind = "part bigint, sums binary, own double"

    def lines(part: int, sums: np.ndarray) -> tuple[list[int], list[bytes], list[float]]:
        return [part], [sums.astype(np.float32).tobytes()], [float(np.trace(sums, part))]

    def summed(low: int) -> DataFrame:
        high = min(low + height, size)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, places = None, line_places(low, high, size)
            for batch in make(batches) if make else batches:
                word, weight = batch.column(0), batch.column(1)
                first = np.asarray(word.offsets) - word.offsets[0].as_py()
                out = np.zeros(places[high - 1] + size) if out is None else out
                add_pairs(out, places, np.asarray(word.flatten(), np.int64), np.asarray(weight.flatten(), np.float64), first)
            for k in range(low, high, deep) if out is not None else ():
                part = np.zeros((min(k + deep, high) - k, size))
                for i, line in enumerate(part, k):
                    line[i:] = out[places[i] + i : places[i] + size]
                yield pa.RecordBatch.from_pydict(dict(zip(("part", "sums", "own"), lines(k, part), strict=True)))

        return rows.coalesce(cores).mapInArrow(run, kind)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in t["sums"]).reshape(-1, size)
        return pa.table(dict(zip(("part", "sums", "own"), lines(t["part"][0].as_py(), total), strict=True)))

    parts = [summed(low) for low in range(0, size, height)]
    return materialise(reduce(DataFrame.unionByName, parts).groupBy("part").applyInArrow(add, kind), "gram")


def gram_times(gram: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A^T (A basis) from the lines of :func:`gram_matrix`: one partial product per task, summed slice by slice of the basis's rows."""
    context, shape = gram.sparkSession.sparkContext, basis.shape
    shared = context.broadcast(basis.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, right = np.zeros(shape), shared.value
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                upper = np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, shape[0]).copy()
                out[part : part + len(upper)] += upper @ right
                upper[np.arange(len(upper)), part + np.arange(len(upper))] = 0
                out += upper.T @ right[part : part + len(upper)]
        for k in range(0, shape[0], 256):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out[k : k + 256].tobytes()], pa.binary())], ["part", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t["sums"])
        return pa.table({"part": t["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "part bigint, sums binary"
    lines = gram.select("part", "sums").coalesce(context.defaultParallelism)
    got = lines.mapInArrow(run, kind).groupBy("part").applyInArrow(add, kind).toArrow().sort_by("part")
    shared.unpersist()
    out = [np.frombuffer(x.as_py()).reshape(-1, shape[1]) for x in got["sums"]]
    return np.concatenate(out) if out else np.zeros(shape)


def gram_products(rows: DataFrame, basis: np.ndarray, small: bool) -> np.ndarray:
    """The products of :func:`_gram` over rows in Spark (words ascending)."""
    product = gram_times(gram_matrix(rows, len(basis)), basis)
    return basis.T @ product if small else product


def latent_space(
    own: list[tuple[np.ndarray, np.ndarray]], corpus: DataFrame, size: int, rank: int = RANK, make: BatchMap | None = None
) -> np.ndarray:
    """Right singular vectors (words by dimensions) of the benchmark's rows and the corpus rows (``make``: see :func:`gram_matrix`).

    All corpus rows take part, by their Gram matrix, which is summed once. The corpus rows (unit vectors) together weigh as much
    as the benchmark's, however many they are.
    """
    gram = gram_matrix(corpus, size, make)
    n = gram.agg(F.sum("own")).first()[0] or 0.0
    weight = len(own) / n if n else 0.0
    width = min(rank + EXTRA, size)
    basis = np.linalg.qr(np.random.default_rng(7).normal(size=(size, width)))[0]
    for _ in range(ROUNDS):
        product = _gram(own, basis, False) + (weight * gram_times(gram, basis) if n else 0)
        basis = np.linalg.qr(product)[0]
    inner = _gram(own, basis, True) + (weight * (basis.T @ gram_times(gram, basis)) if n else 0)
    _, turn = np.linalg.eigh((inner + inner.T) / 2)
    return (basis @ turn[:, ::-1][:, :rank]).astype(np.float32)


class Finder:
    """Finds the leaks of a block of passages in slices of texts; built in each task from the broadcast model.

    A window's projection is a sum over its words, and so is its product with a passage's latent vector: ``affinity`` holds
    that product for every word and passage, and windows are sums over steps of ``STEP`` words.
    """

    def __init__(self, words: Vocabulary, idf: np.ndarray, other: float, affinity: np.ndarray, passages: list[Passage]):
        self.words, self.idf, self.other = words, idf.astype(np.float32), other
        self.affinity, self.passages = affinity, passages
        self.sizes = np.array([p.size for p in passages])
        numbers = [words.find(np.array(p.words, np.uint64)) for p in passages]
        #: Places in each passage (as bits) of every word, with a row of unknown words at the end.
        self.places = np.zeros((len(words.hashes) + 1, len(passages)), np.uint64)
        for k, (p, number) in enumerate(zip(passages, numbers, strict=True)):
            self.places[number, k] = [p.places[w] for w in p.words]
        # passages by their rarest word, with its place and the hash of all their words
        rare = [int(np.argmax(self.idf[number])) for number in numbers]
        anchor = np.array([number[r] for number, r in zip(numbers, rare, strict=True)])
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.anchored = np.searchsorted(anchor[self.by_anchor], np.arange(len(words.hashes) + 1))
        self.rare = np.array(rare)
        whole = [RangeHasher(np.array(p.words, np.uint64))(np.array([0]), np.array([p.size])) for p in passages]
        self.whole = np.concatenate(whole)

    def copies(self, h: np.ndarray, first: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Exact copies of passages: (text, passage, first word), the first of a passage in each text."""
        word = np.where(found >= 0, found, 0)
        many = np.where(found >= 0, self.anchored[word + 1] - self.anchored[word], 0)
        at = np.repeat(np.arange(len(h)), many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        p = self.by_anchor[self.anchored[found[at]] + nth]
        start, end = at - self.rare[p], at - self.rare[p] + self.sizes[p]
        text = np.searchsorted(first, at, "right") - 1
        inside = (start >= first[text]) & (end <= first[text + 1])
        p, start, end, text = p[inside], start[inside], end[inside], text[inside]
        same = RangeHasher(h)(start, end) == self.whole[p]
        p, start, end, text = p[same], start[same], end[same], text[same]
        order = np.lexsort((start, p, text))
        last = None
        for i in order.tolist():
            k = int(p[i])
            if last != (text[i], k) and h[start[i] : end[i]].tolist() == self.passages[k].words:
                last = (text[i], k)
                yield int(text[i]), k, int(start[i])

    def regions(self, found: np.ndarray, first: np.ndarray, text: np.ndarray, p: np.ndarray, a: np.ndarray, b: np.ndarray):
        """Regions around windows (first and end word), and whether enough of the passage's places have a word in them.

        No common subsequence is longer than the number of these places, so nothing that ``confirm`` would take is lost.
        """
        around = np.maximum(STEP, self.sizes[p] // 2)
        lo, hi = np.maximum(a - around, first[text]), np.minimum(b + around, first[text + 1])
        able = np.zeros(len(p), bool)
        for k in range(0, len(p), 1024):
            x, y, q = lo[k : k + 1024], hi[k : k + 1024], p[k : k + 1024]
            seen = np.zeros(len(q), np.uint64)
            for i in range(int((y - x).max())):
                at = x + i
                seen |= self.places[np.where(at < y, found[np.minimum(at, len(found) - 1)], -1), q]
            able[k : k + 1024] = np.bitwise_count(seen) / self.sizes[q] >= LCS_WITH
        return lo, hi, able

    def windows(self, first: np.ndarray, found: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates of each scale: texts, passages, first and end words of the windows, cosines."""
        if not len(found):
            return
        n = np.diff(first)
        known = found >= 0
        length = np.where(known, self.idf[found], self.other).astype(np.float64) ** 2
        steps = -(-n // STEP)
        begin = np.concatenate([[0], np.cumsum(steps)])
        step = np.repeat(begin[:-1], n) + (np.arange(len(found)) - np.repeat(first[:-1], n)) // STEP
        norms = np.concatenate([[0], np.cumsum(np.bincount(step, length, begin[-1]))])
        at = np.flatnonzero(known)
        sums = np.zeros((begin[-1] + 1, len(self.passages)))
        if len(at):
            cut = np.flatnonzero(np.diff(step[at], prepend=-1))
            sums[step[at][cut] + 1] = np.add.reduceat(self.affinity[found[at]], cut, axis=0)
        np.cumsum(sums, axis=0, out=sums)
        text = np.repeat(np.arange(len(n)), steps)
        for scale in SCALES:
            start = np.arange(begin[-1])
            end = np.minimum(start + scale, begin[text + 1])
            keep = (end - start == scale) | (start == begin[text])  # a short text has one window
            start, end, of = start[keep], end[keep], text[keep]
            whole = np.sqrt(np.maximum(norms[end] - norms[start], 1e-9))
            cosine = (sums[end] - sums[start]) / whole[:, None]
            i, p = np.nonzero(cosine >= COSINE)
            t = of[i]
            a = first[t] + (start[i] - begin[t]) * STEP
            yield t, p, a, np.minimum(a + scale * STEP, first[t + 1]), cosine[i, p]

    def cosine(self, found: np.ndarray, passage: int) -> float:
        """Latent cosine of a run of known words with a passage."""
        length = np.linalg.norm(self.idf[found].astype(np.float64))
        return float(self.affinity[found, passage].sum(dtype=np.float64) / max(length, 1e-9))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list:
        leaks: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
        for lo in range(0, len(leaks), 64):  # few texts at a time
            some = offsets[lo : lo + 65]
            h, first = word_hashes(data[some[0] : some[-1]], some - some[0])
            best: dict[tuple[int, int], dict] = {}
            found = self.words.find(h)
            for texts, ps, starts, ends, cosines in self.windows(first, found):
                lows, highs, able = self.regions(found, first, texts, ps, starts, ends)
                columns = [x[able].tolist() for x in (texts, ps, starts, lows, highs, cosines)]
                for text, p, a, low, high, cosine in zip(*columns, strict=True):
                    passage = self.passages[p]
                    whole, answer, leak = passage.confirm(h[low:high].tolist())
                    if leak and best.get((text, p), {"lcs": -1})["lcs"] < whole:
                        best[text, p] = {"item_id": passage.item, "lcs": whole, "answer": answer, "cosine": cosine, "word": a - int(first[text])}
            for text, p, a in self.copies(h, first, found):
                if best.get((text, p), {"lcs": -1})["lcs"] < 1:
                    passage = self.passages[p]
                    cosine = self.cosine(found[a : a + passage.size], p)
                    best[text, p] = {"item_id": passage.item, "lcs": 1.0, "answer": 1.0, "cosine": cosine, "word": a - int(first[text])}
            for (text, _), leak in sorted(best.items()):
                leaks[lo + text].append(leak)
        return [leaks]


LEAKS = "array<struct<item_id:bigint,lcs:double,answer:double,cosine:double,word:bigint>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add ``leaks`` to ``docs`` (doc_id, text and any other columns): for every benchmark passage found, its item, the shares
    of the passage and its answer found in order, the latent cosine and the first word of the window (of an exact copy that
    no window led to, of the copy itself). Clean documents have none.

    ``benchmark`` has item_id and text; null and empty items never match, equal items match alike. Null and empty
    documents have no leaks; repeated rows get equal results; empty tables work; other columns pass through.
    The items are read by the driver in blocks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("leaks")
    columns, parts = docs.columns, []
    passages = read_passages(benchmark)
    out = docs
    for k in range(0, len(passages), BLOCK):
        block = passages[k : k + BLOCK]
        words = Vocabulary(np.array([w for p in block for w in p.words], np.uint64))
        seen, n = document_frequencies(docs, words)
        idf = np.log((n + 1) / (seen + 1)) + 0.05
        rows = [next(rows_of(words.find(np.array(p.words, np.uint64)), np.array([0, p.size]), idf)) for p in block]
        space = latent_space(rows, docs.select("text"), len(words.hashes), make=passage_rows(words, idf))
        latent = np.stack([x.astype(np.float64) @ space[w] for w, x in rows])
        latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        affinity = (idf[:, None] * (space @ latent.T)).astype(np.float32)
        ready = spark.sparkContext.broadcast((words, idf, float(np.median(idf)), affinity, block))
        out = add_scores(out, "text", f"_leaks{k} {LEAKS}", lambda ready=ready: Finder(*ready.value))
        parts.append(f"_leaks{k}")
    found = F.concat(*parts) if parts else F.array().cast(LEAKS)
    return out.withColumn("leaks", found).select(*[F.col(f"`{c}`") for c in columns], "leaks")


def op4_latent_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.groupBy("doc_id", F.col("leak.item_id").alias("item_id")).agg(
        F.max("leak.lcs").alias("lcs"),
        F.max("leak.answer").alias("answer"),
        F.max("leak.cosine").alias("cosine"),
        F.min("leak.word").alias("first_word"),
    )
