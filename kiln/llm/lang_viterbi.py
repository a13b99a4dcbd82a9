"""Language identification by word: script ranges, per-word scores, Viterbi with a switching penalty.

The script of a word's letters leaves only languages that use it. Each remaining language scores the word
with its character model, and the best path through a text, where changing the language costs ``PENALTY``,
labels every word; runs of equal labels are the spans of a mixed-language text.

The paths of all texts of a slice are found together: texts are cut into blocks of ``BLOCK`` words, the best
way from each entering to each leaving language of a block is computed for all blocks at once, the blocks of a text are
chained, and the labels inside the blocks are traced back together. This equals the plain recursion.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.char_grams import CharModels, gram_counts, plain, share_of
from kiln.llm.common import held_out, table
from kiln.llm.scoring import WordTable, add_scores, texts_of
from kiln.llm.words import sums_by_doc

ORDER = 4
PENALTY = 8.0
BLOCK = 32
PER_LANG = 1500
#: Letters of a language to learn from (expected); with ORDER n-grams for each at most, the size of the model is bounded.
MAX_LETTERS = 8_000_000
#: Bytes of the matrices of a slice's blocks.
MATRIX_BYTES = 64 << 20
#: A word's score may fall below that of its best language by this much at most.
FLOOR = -12.0
#: Least share of a language's letters in a script it is said to use.
SCRIPT_SHARE = 0.01
#: First code points of scripts and the scripts; 0 is none.
SCRIPT_STARTS = [
    (0x0000, 0), (0x0041, 1), (0x005B, 0), (0x0061, 1), (0x007B, 0), (0x00C0, 1), (0x0250, 0), (0x0370, 2), (0x0400, 3), (0x0530, 4),
    (0x0590, 5), (0x0600, 6), (0x0700, 0), (0x0750, 6), (0x0780, 0), (0x0900, 7), (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 11),
    (0x0B80, 12), (0x0C00, 13), (0x0C80, 14), (0x0D00, 15), (0x0D80, 16), (0x0E00, 17), (0x0E80, 18), (0x0F00, 19), (0x1000, 20),
    (0x10A0, 21), (0x1100, 22), (0x1200, 23), (0x1380, 0), (0x1780, 24), (0x1800, 25), (0x18B0, 0), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x3040, 26), (0x3100, 0), (0x3400, 27), (0x4DC0, 0), (0x4E00, 27), (0xA000, 0), (0xAC00, 22), (0xD7B0, 0),
    (0xF900, 27), (0xFB00, 0), (0x20000, 27), (0x30000, 0),
]
SCRIPTS = 28
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_KINDS = np.array([k for _, k in SCRIPT_STARTS])


def word_scripts(words: list[str]) -> np.ndarray:
    """Letters of every word by script (rows: words)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    kinds = _KINDS[np.searchsorted(_STARTS, points, "right") - 1]
    out = np.bincount(np.repeat(np.arange(len(words)), sizes) * SCRIPTS + kinds, minlength=len(words) * SCRIPTS)
    out = out.reshape(len(words), SCRIPTS)
    out[:, 0] = 0
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY, block: int = BLOCK) -> np.ndarray:
    """Best label of every word. ``scores``: words by labels; ``first``: where each text's words begin (one more at the end).

    Of equal paths, staying in a language wins, then the lower label.
    """
    n, size = np.diff(first), scores.shape[1]
    if not len(scores):
        return np.zeros(0, np.int64)
    block = max(block, -(-len(scores) * size * size * 8 // MATRIX_BYTES))  # longer blocks, fewer matrices
    per = -(-n // block)
    blocks, begin = int(per.sum()), np.concatenate([[0], np.cumsum(per)])
    inside = np.arange(len(scores)) - np.repeat(first[:-1], n)
    spot = np.repeat(begin[:-1], n) + inside // block
    s = np.zeros((block, blocks, size))
    s[inside % block, spot] = scores
    # best way through each block from each entering label
    through = np.where(np.eye(size, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)
    for t in range(block):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + s[t][:, None, :]
    # chain the blocks of each text
    enter = np.zeros((blocks, size))
    last = np.zeros((len(n), size))
    for j in range(int(per.max())):
        texts = np.flatnonzero(per > j)
        at = begin[texts] + j
        enter[at] = last[texts]
        last[texts] = (enter[at][:, :, None] + through[at]).max(axis=1)
    leave = np.zeros(blocks, np.int64)
    label = last.argmax(axis=1)
    for j in range(int(per.max()) - 1, -1, -1):
        texts = np.flatnonzero(per > j)
        at = begin[texts] + j
        leave[at] = label[texts]
        label[texts] = (enter[at] + through[at, :, label[texts]]).argmax(axis=1)
    # trace the labels inside all blocks
    value, jumps, best = enter, np.zeros((block, blocks, size), bool), np.zeros((block, blocks), np.int64)
    for t in range(block):
        best[t] = value.argmax(axis=1)
        jump = value.max(axis=1, keepdims=True) - penalty
        jumps[t] = jump > value
        value = np.maximum(value, jump) + s[t]
    labels = np.zeros((block, blocks), np.int64)
    rows = np.arange(blocks)
    for t in range(block - 1, -1, -1):
        labels[t] = leave
        leave = np.where(jumps[t, rows, leave], best[t], leave)
    return labels[inside % block, spot]


class Identifier:
    """Labels slices of texts; built in each task from the broadcast model."""

    def __init__(self, langs: list[str], models: CharModels, uses: np.ndarray, penalty: float):
        self.langs, self.models, self.uses, self.penalty = langs, models, uses, penalty
        self.words = WordTable(len(langs) + 1, self.score)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Per word the scores by language and whether it has a letter."""
        names = [plain(w) for w in words]
        letters = np.array([any(c.isalpha() for c in w) for w in names], float)
        found = self.models.log_likelihoods(names)
        scripts = word_scripts(names)
        allowed = self.uses[scripts.argmax(axis=1)]  # by the word's commonest script
        allowed = allowed | ~allowed.any(axis=1, keepdims=True) | (scripts.max(axis=1) == 0)[:, None]
        found = np.where(allowed, found, -np.inf)
        found = np.maximum(found - found.max(axis=1, keepdims=True), FLOOR)
        return np.concatenate([found * letters[:, None], letters[:, None]], axis=1)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list:
        rows, first = self.words.of(texts_of(data, offsets))
        letters = rows[:, -1].astype(np.float64)
        labels = viterbi(rows[:, :-1].astype(np.float64), first, self.penalty)
        votes = np.stack([sums_by_doc(letters * (labels == j), first) for j in range(len(self.langs))], axis=1)
        total = votes.sum(axis=1)
        best = votes.argmax(axis=1)
        share = votes.max(axis=1) / np.maximum(total, 1)
        names = [self.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        n = np.diff(first)
        new = np.ones(len(labels), bool)
        new[1:] = labels[1:] != labels[:-1]
        new[first[:-1][n > 0]] = True
        starts = np.flatnonzero(new)
        cut = np.searchsorted(starts, first).tolist()
        starts, begin, many = starts.tolist(), first.tolist(), n.tolist()
        spans = []
        for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            at = [x - begin[i] for x in starts[a:b]] + [many[i]]
            spans.append([{"lang": self.langs[labels[begin[i] + x]], "start": x, "end": y} for x, y in zip(at, at[1:], strict=False)])
        return [names, share, spans]


def identify(
    docs: DataFrame, learn: DataFrame, per_lang: int = PER_LANG, max_letters: int = MAX_LETTERS, penalty: float = PENALTY
) -> DataFrame:
    """Add ``lang_pred``, ``lang_score`` (share of the lettered words labelled so) and ``lang_spans`` (lang, start, end in words)
    to ``docs`` (text and any other columns).

    Learns from the rows of ``learn`` (doc_id, text, lang) with a language: about ``per_lang`` of each language (those whose id
    hash is below a threshold that follows from the number of its rows and letters, of which about ``max_letters`` at most), and from
    every n-gram in them. A
    text that is null or has no letter is ``und`` with score 0, as is every text when there is nothing to learn from. Ties go to the
    language that comes first. Repeated rows score alike; an empty table stays empty; other columns pass through.
    """
    spark = docs.sparkSession
    learn = learn.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("letters"))
    shares = {r["lang"]: share_of(r["rows"], r["letters"], per_lang, max_letters) for r in sizes.collect()}  # one row per language
    langs = sorted(shares)
    schema = "lang_pred string, lang_score double, lang_spans array<struct<lang:string,start:bigint,end:bigint>>"
    if not langs:
        unknown = {"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)}
        return docs.withColumns(unknown | {"lang_spans": F.array().cast(schema.rpartition(" ")[2])})
    number = F.create_map(*[F.lit(x) for k, name in enumerate(langs) for x in (name, k)])
    below = F.create_map(*[F.lit(x) for name in langs for x in (name, shares[name])])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 20)) / (1 << 20)
    sample = learn.where(chance < below[F.col("lang")]).select("text", number[F.col("lang")].alias("group"))
    k, gram, context, c = gram_counts(sample, len(langs), ORDER)
    models = CharModels(k, gram, context, c)
    scripts = sample.select("group", "text")
    letters = add_scores(
        scripts, "text", ", ".join(f"s{j} bigint" for j in range(SCRIPTS)), lambda: script_counts
    ).groupBy("group").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(SCRIPTS)])
    uses = np.zeros((SCRIPTS, len(langs)), bool)
    for r in letters.collect():  # one row per language
        own = np.array(r[1:], float)
        uses[:, r["group"]] = own > SCRIPT_SHARE * max(own.sum(), 1)
    ready = spark.sparkContext.broadcast((langs, models, uses, penalty))
    return add_scores(docs, "text", schema, lambda: Identifier(*ready.value))


def script_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return list(word_scripts([t.decode("utf-8", "replace") for t in texts_of(data, offsets)]).T)


def op7_lang_viterbi(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"), 3, 1)
    found = identify(docs.select("doc_id", "text"), docs.where(~held))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.size("lang_spans").cast("long").alias("n_spans"),
    )
