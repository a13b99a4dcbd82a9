"""Quality rules as a ledger of bit masks.

Every rule is evaluated once per document; the ledger keeps the measurements and one bit per failed
rule. A policy is a named, versioned set of rules (a mask): applying another policy, or asking what a
rule costs, reads the ledger and never the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import small_batches, table
from kiln.llm.words import Hasher, find_words, mix64, sums_by_doc, text_slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_digits",
]

#: Rules by bit: (name, failure condition over the measurements). New rules are appended; a bit never changes meaning.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("upper_case", "n_letters >= 50 AND 10 * n_upper > 6 * n_letters"),
    ("digits", "10 * n_digits > 3 * word_chars"),
    ("no_letters", "n_letters = 0"),
]
#: Policies by version: names of the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "web-1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "web-2": tuple(name for name, _ in RULES),
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit keys: which occur twice or more, and which equal an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def measure_texts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of every text of a slice. Equality of lines and windows is that of 64-bit hashes within a text."""
    n = len(offsets) - 1
    w = find_words(data, offsets)
    hashes = Hasher(data)
    counts = np.diff(w.first)
    heads = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.subtract.at(inside, w.ends, 1)
    in_word = np.cumsum(inside[:-1], dtype=np.int8) > 0
    upper = (data >= 65) & (data <= 90)
    letters = upper | ((data >= 97) & (data <= 122)) | (data >= 0xC3)
    out = {
        "n_words": counts,
        "word_chars": sums_by_doc(heads & in_word, offsets),
        "n_symbols": sums_by_doc(_SYMBOL[data], offsets),
        "n_letters": sums_by_doc(letters, offsets),
        "n_upper": sums_by_doc(upper, offsets),
        "n_digits": sums_by_doc((data >= 48) & (data <= 57), offsets),
    }
    # lines: cut at line feeds and at text borders; only lines with a word count
    cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts < len(data)]
    ends = np.append(cuts[1:], len(data)) if len(cuts) else cuts
    ends = ends - (data[ends - 1] == 10) if len(cuts) else ends
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, cuts)
    cuts, ends = cuts[worded], ends[worded]
    of = np.searchsorted(offsets, cuts, "right") - 1
    salt = mix64(np.arange(1, n + 1, dtype=np.uint64))
    _, later = _repeats(mix64(hashes(cuts, ends) ^ salt[of]))
    out["n_lines"], out["n_dup_lines"] = np.bincount(of, minlength=n), np.bincount(of[later], minlength=n)
    # windows of words
    doc, h = w.doc(), hashes(w.starts, w.ends)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        m = len(h) - WINDOW + 1
        key = np.zeros(m, np.uint64)
        for k in range(WINDOW):
            key = mix64(key + h[k : k + m] * np.uint64(2 * k + 1))
        at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        twice, _ = _repeats(key[at] ^ salt[doc[at]])
        hit = at[twice]
        covered[hit] += 1
        covered[hit + WINDOW] -= 1
    out["n_repeat_words"] = sums_by_doc((np.cumsum(covered[:-1]) > 0).astype(np.int64), w.first)
    return out


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and the measurements (longs). Null and empty texts measure 0."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                m = measure_texts(data, offsets)
                cols = [pa.array(m[c].astype(np.int64)) for c in MEASURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], ["doc_id", *MEASURES])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in MEASURES))


def ledger(docs: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """Measurements and ``failures``: bit k is set where rule k fails.

    Every document gets a row: null and empty texts have no words and fail the rules on that; repeated rows
    and ids give repeated rows; an empty table gives none; other columns are not read.
    """
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, cond) in enumerate(rules or RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return measure(docs).withColumn("failures", failures)


def policy_mask(policy: str | tuple[str, ...], rules: list[tuple[str, str]] | None = None) -> int:
    names = [name for name, _ in rules or RULES]
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def ablation(kept: DataFrame, policy: str) -> DataFrame:
    """What every rule of a policy costs, from the ledger alone: rows it fails, rows only it fails (kept without it),
    and the rules that fail on any and on all of the rows it fails (bitwise or / and). One partial aggregate over the ledger;
    a rule that fails on no row has zeros and a null ``with_all``."""
    mask = policy_mask(policy)
    own = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
    aggs = []
    for k, (name, _) in enumerate(RULES):
        if mask >> k & 1:
            failed = own.bitwiseAND(F.lit(1 << k).cast("long")) != 0
            aggs += [
                F.count_if(failed).alias(f"{k}_fails"),
                F.count_if(own == (1 << k)).alias(f"{k}_alone"),
                F.coalesce(F.bit_or(F.when(failed, own)), F.lit(0)).alias(f"{k}_or"),
                F.bit_and(F.when(failed, own)).alias(f"{k}_and"),
            ]
    one = kept.agg(*aggs)
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"{k}_fails").alias("fails"),
            F.col(f"{k}_alone").alias("fails_alone"),
            F.col(f"{k}_or").alias("with_any"),
            F.col(f"{k}_and").alias("with_all"),
        )
        for k, (name, _) in enumerate(RULES)
        if mask >> k & 1
    ]
    return one.select(F.inline(F.array(*rows)))


def op10_rule_ledger(spark, sf_dir):
    rows = ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[c for c in MEASURES if c not in ("n_lines", "n_letters", "n_upper", "n_digits")],
        (~passes("base-1")).alias("base_failed"),
        (passes("base-1") & passes("web-2")).alias("kept"),
        "failures",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
b AS (SELECT row, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS n_letters,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, doc_id, words FROM w),
win AS (SELECT row, i, array_to_string(words[i:i+7], ' ') AS k FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM b)),
twice AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT row, count(DISTINCT p)::BIGINT AS n FROM (SELECT row, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY row),
m AS (SELECT b.*, len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN rep USING (row)),
f AS (SELECT *, ({bits})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
""".replace("{bits}", " + ".join(f"CASE WHEN {cond} THEN {1 << k} ELSE 0 END" for k, (_, cond) in enumerate(RULES)))
