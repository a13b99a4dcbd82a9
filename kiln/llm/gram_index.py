"""Spelling variants by an index of variable-length grams.

Method (after Li, Wang and Yang, "VGRAM", 2007), for words at an edit distance of one:

* **Dictionary.** All grams of ``QMIN`` to ``QMAX - 1`` symbols of all words (an end mark included) are counted by Spark; those above
  one in ``DICTIONARY`` of all places are frequent. A frequent gram is extended, an infrequent one is not, so the
  dictionary is a pruned tree, and its size is bounded whatever the number of words.
* **Decomposition.** The gram at a place of a word grows from ``QMIN`` symbols while it is frequent, up to half of the word. Which gram
  begins at a place depends on its own symbols only, so an edit changes exactly the grams that cover it.
* **Affected grams.** Of two grams that do not overlap, one edit affects one at most. For every word, the two such grams with
  the shortest lists are looked up: a partner has the left one at the same place if the edit lies behind it, and the right
  one at the place shifted by the difference in length if the edit lies before it, and one of the two is the case.
* **Merging and verifying.** The two lists (words by gram, place and length) are merged by a join on their key. Pairs whose letters
  differ too much are dropped, the edit distance decides, and a partner that the left gram finds is left out of the right
  gram's list, so every pair is found exactly once, and none is missed.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialise, small_batches, table
from kiln.llm.words import find_words, lower_ascii, mix64, text_slices

QMIN, QMAX = 2, 6
#: A gram is frequent above this part of all places, so fewer than QMAX - QMIN times as many are.
DICTIONARY = 50_000
#: Grams are taken from the first places of a word (all of an ordinary word).
WINDOW = 48
#: Words handled at once, and distinct words that a task counts before it hands them on.
CHUNK, COUNTED = 20_000, 200_000
#: Words shorter than this have no two grams that do not overlap.
LEAST = 4
_END, _SYMBOLS = 127, 126
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_OUTSIDE = np.array([True] + [False] * 255)


def letter_runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF of at least so many letters: byte ranges (starts, ends), letters, and text."""
    mark = _LETTER[data]
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
    mark |= lead
    mark[1:] |= lead[:-1]
    w = find_words(mark.astype(np.uint8), offsets, _OUTSIDE)
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    size = letters[w.ends] - letters[w.starts]
    long = size >= least
    return w.starts[long], w.ends[long], size[long], w.doc()[long]


def misspelt(word: bytes, letters: int, number: int) -> bytes:
    """The word without its letter ``number % letters``."""
    at, text = number % letters, word.decode()
    return (text[:at] + text[at + 1 :]).encode()


def count_runs(docs: DataFrame, least: int, drop: int | None) -> DataFrame:
    """word and n over all texts: letter runs of ``docs`` (doc_id, text), A-Z lower-cased, of ``least`` letters or more.

    With ``drop``, a run loses its letter h % length first where ``drop`` divides h, the CRC-32 of ``<doc_id>:<run>`` (not in
    documents without an id).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen.keys()), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, data, offsets in text_slices(batch.column(1)):
                starts, ends, size, doc = letter_runs(data, offsets, least)
                raw = lower_ascii(data).tobytes()
                words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                if drop:
                    begin = [None if i is None else zlib.crc32(b"%d:" % i) for i in ids[a:b]]
                    known = np.array([x is not None for x in begin])[doc]
                    prefix = np.array([x or 0 for x in begin], np.int64)[doc]
                    h = np.fromiter(map(zlib.crc32, words, prefix.tolist()), np.int64, len(words))
                    hit = np.flatnonzero((h % drop == 0) & known)
                    for k in hit.tolist():
                        words[k] = misspelt(words[k], int(size[k]), int(h[k])) if size[k] > least else b""
                seen.update(words)
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n bigint")
    return counted.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Grams:
    """Grams of a block of words: symbols in a matrix (rows: words), packed in numbers of 7 bits a symbol."""

    def __init__(self, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(min(self.length.max(initial=0), WINDOW + QMAX)) + 1
        shown = [w[: self.width] for w in words]
        flat = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        inside = np.arange(self.width) < np.minimum(self.length, self.width)[:, None]
        symbol = np.zeros((len(words), self.width + QMAX), np.int64)
        symbol[:, : self.width][inside] = flat % _SYMBOLS + 1
        ended = np.flatnonzero(self.length < self.width)
        symbol[ended, self.length[ended]] = _END
        self.left = np.maximum(self.length[:, None] + 1 - np.arange(self.width), 0)  # symbols from a place on
        packed = symbol[:, : self.width].copy()
        self.packed = {1: packed}
        for q in range(2, QMAX + 1):
            packed = (packed << 7) | symbol[:, q - 1 : q - 1 + self.width]
            self.packed[q] = packed
        bits = np.where(inside, np.int64(1) << (symbol[:, : self.width] % 64), 0)
        self.letters = np.bitwise_or.reduce(bits, axis=1) if self.width else np.zeros(len(words), np.int64)

    def counts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for q in range(QMIN, QMAX):
            yield np.unique(self.packed[q][self.left >= q], return_counts=True)

    def look_up(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Find the frequent grams: how often a gram of q symbols occurs (0: not frequent)."""
        self.often = {}
        for q in range(QMIN, QMAX):
            at = np.minimum(np.searchsorted(grams, self.packed[q]), max(len(grams) - 1, 0))
            known = (grams[at] == self.packed[q]) & (self.left >= q) if len(grams) else np.zeros(self.left.shape, bool)
            self.often[q] = np.where(known, counts[at] if len(grams) else 0, 0)
        self.often[QMAX] = np.zeros(self.left.shape, np.int64)

    def decompose(self, target: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, its size, its estimated list) at every place of the window, as in a word of ``target`` letters; size 0: no gram."""
        most = np.minimum(QMAX, (target + 1) // 2)[:, None]
        size = np.where(self.left >= QMIN, QMIN, 0)
        for q in range(QMIN, QMAX):
            size = np.where((size == q) & (most > q) & (self.left > q) & (self.often[q] > 0), q + 1, size)
        size[:, window:] = 0
        gram, cost = np.zeros(size.shape, np.int64), np.zeros(size.shape, np.int64)
        for q in range(QMIN, QMAX + 1):
            here = size == q
            gram = np.where(here, self.packed[q], gram)
            # an infrequent gram's list is a part of its parent's
            parent = self.often[q - 1] // 8 if q > QMIN else 1
            cost = np.where(here, np.where(self.often[q] > 0, self.often[q], parent), cost)
        return gram, size, cost

    def pairs(self, size: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two grams that do not overlap and have the shortest lists together (-1: there are none)."""
        n, far = len(size), np.int64(1) << 60
        low = np.full((n, self.width + QMAX + 1), far)  # the shortest list of a gram that ends here, and its place
        whose = np.full(low.shape, -1)
        total, left, right = np.full(n, far), np.full(n, -1), np.full(n, -1)
        best, best_at, rows = np.full(n, far), np.full(n, -1), np.arange(n)
        for p in range(size.shape[1]):
            closer = low[:, p] < best
            best, best_at = np.where(closer, low[:, p], best), np.where(closer, whose[:, p], best_at)
            here = size[:, p] > 0
            both = np.where(here & (best_at >= 0), best + cost[:, p], far)
            better = both < total
            total, left, right = np.where(better, both, total), np.where(better, best_at, left), np.where(better, p, right)
            end = p + size[:, p]
            shorter = here & (cost[:, p] < low[rows, end])
            low[rows[shorter], end[shorter]] = cost[shorter, p]
            whose[rows[shorter], end[shorter]] = p
        return left, right


def list_key(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The list of the words of this length that have the gram at this place (64 bits; the verification excludes collisions)."""
    x = mix64(gram.astype(np.uint64)) + (place.astype(np.uint64) << np.uint64(32)) + length.astype(np.uint64)
    return mix64(x).view(np.int64)


def in_blocks(words: DataFrame, schema: str, make: Callable[[list[str], np.ndarray], list]) -> DataFrame:
    """Apply ``make(words, n)``, which gives the columns of ``schema``, to blocks of words."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[str] = []
        n: list[np.ndarray] = []
        for batch in batches:
            kept += batch.column(0).to_pylist()
            n.append(batch.column(1).to_numpy())
            if len(kept) >= CHUNK:
                yield pa.RecordBatch.from_arrays(make(kept, np.concatenate(n)), names)
                kept, n = [], []
        if kept:
            yield pa.RecordBatch.from_arrays(make(kept, np.concatenate(n)), names)

    return words.select("word", "n").mapInArrow(run, schema)


def frequent_grams(words: DataFrame, dictionary: int = DICTIONARY) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's inner grams (packed, ascending) and their counts; fewer than ``(QMAX - QMIN) * dictionary``."""

    def count(block: list[str], _n: np.ndarray) -> list:
        grams, counts = (np.concatenate(x) for x in zip(*Grams(block).counts(), strict=True))
        return [pa.array(grams), pa.array(counts)]

    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    found = in_blocks(words, "gram bigint, c bigint", count).groupBy("gram").agg(F.sum("c").alias("c"))
    t = found.where(F.col("c") > max(8, places // dictionary)).orderBy("gram").toArrow()
    return t["gram"].to_numpy(), t["c"].to_numpy()


def near_words(words: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """All pairs of different words (``words``: word, n; each once, of LEAST letters or more) at an edit distance of one.

    Returns word, n, other, other_n; each pair in both directions.
    """
    context = words.sparkSession.sparkContext
    frequent = context.broadcast(frequent_grams(words, dictionary))

    def gathered(block: list[str], row: np.ndarray) -> pa.Array:
        return pa.array(block, pa.string()).take(pa.array(row))

    def index(block: list[str], n: np.ndarray) -> list:
        g = Grams(block)
        g.look_up(*frequent.value)
        gram, size, _ = g.decompose(g.length, WINDOW)
        row, place = np.nonzero(size)
        key = list_key(gram[row, place], place, g.length[row])
        return [pa.array(key), gathered(block, row), pa.array(n[row]), pa.array(g.letters[row])]

    def probe(block: list[str], n: np.ndarray) -> list:
        g = Grams(block)
        g.look_up(*frequent.value)
        parts = []
        for change in (-1, 0, 1):
            target = g.length + change
            gram, size, cost = g.decompose(target, WINDOW - 1)  # one place less, for the shift
            left, right = g.pairs(size, cost)
            row = np.flatnonzero((right >= 0) & (target >= LEAST))
            left, right = left[row], right[row]
            for place, shift, first in ((left, 0, True), (right, change, False)):
                key = list_key(gram[row, place], place + shift, target[row])
                parts.append((key, row, left, size[row, left], np.full(len(row), first)))
        key, row, left, size, first = (np.concatenate(x) for x in zip(*parts, strict=True))
        word = [gathered(block, row), pa.array(n[row]), pa.array(g.letters[row])]
        return [pa.array(key), *word, pa.array((left + 1).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(first)]

    lists = in_blocks(words, "key bigint, other string, other_n bigint, other_letters bigint", index)
    asked = in_blocks(words, "key bigint, word string, n bigint, letters bigint, place int, size int, first boolean", probe)
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2
    near = (F.levenshtein("word", "other", 1) >= 0) & (F.col("word") != F.col("other"))
    has_left = F.expr("substring(other, place, size) = substring(word, place, size)")
    pairs = asked.join(lists, "key").where(alike & near & (has_left == F.col("first")))
    return pairs.select("word", "n", "other", "other_n")


def roots_of(forms: DataFrame) -> DataFrame:
    """``forms``: word and form, without cycles. Returns word and root: the last form reached.

    Every round doubles the steps taken; only a count reaches the driver.
    """
    roots = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(words: DataFrame, times: int = 10, dictionary: int = DICTIONARY) -> DataFrame:
    """Group the words of ``words`` (word, n; each word once) with the far more frequent words that they may be a misspelling of.

    Two words are near if exactly one inserted, deleted or replaced code point makes one the other. A word's form is its
    near word of the largest n (ties: the first in code-point order) if that n is at least ``times`` the word's own.
    Returns word, form (null: none), root (the last form reached, the word itself if it has none), n, n_near, form_n.
    Words of fewer than LEAST letters and null words are not compared: they have no near word. Long words are compared whole. An
    empty table gives no rows; extra columns are not read.
    """
    small_batches(words.sparkSession)
    words = words.select("word", F.col("n").cast("long").alias("n"))
    near = near_words(words.where(F.length("word") >= LEAST), dictionary)
    likely = F.when(F.col("other_n") >= times * F.col("n"), F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(likely).alias("best"))
    near = materialise(near.select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")), "near")
    roots = roots_of(near.where("form IS NOT NULL").select("word", "form"))
    return (
        words.join(near, "word", "left")
        .join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
        )
    )


def op11_gram_variants(spark, sf_dir):
    small_batches(spark)
    words = materialise(count_runs(table(spark, sf_dir, "documents"), 7, 31).where("n >= 2"), "words")
    return spelling_variants(words)


ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i::UBIGINT AS c FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
hashed AS (
  SELECT w, xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS h
  FROM (SELECT w, hex(encode(doc_id || ':' || w)) AS x FROM runs WHERE length(w) >= 7), crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN w[1 : (h % length(w))::BIGINT] || w[(h % length(w))::BIGINT + 2 :] ELSE w END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cuts AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS cut FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS form, max(other_n) AS form_n FROM near GROUP BY ALL),
forms AS (SELECT word, form, form_n FROM best WHERE form_n >= 10 * n),
follow AS (
  SELECT word, form AS root, 1 AS steps FROM forms
  UNION ALL SELECT follow.word, forms.form, steps + 1 FROM follow JOIN forms ON forms.word = follow.root),
roots AS (SELECT word, arg_max(root, steps) AS root FROM follow GROUP BY word)
SELECT word, f.form, coalesce(r.root, word) AS root, words.n::BIGINT AS n, coalesce(b.n_near, 0)::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM words LEFT JOIN best b USING (word) LEFT JOIN forms f USING (word) LEFT JOIN roots r USING (word)
"""
