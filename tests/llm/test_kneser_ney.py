"""The models of toxicity are Kneser-Ney: shorter n-grams have continuation counts that both classes share."""

import numpy as np

from kiln.llm.char_grams import CharModels, char_grams, gram_counts, kneser_ney

ROWS = [("xabcy stay", 0), ("tabco abc ab stay", 1), ("cab abcab", 2), ("zabz abd", 3)]
WITHOUT = [[], [0, 2]]


def _counts(spark):
    return gram_counts(spark.createDataFrame(ROWS, "text string, group int"), 4, 4, WITHOUT)


def _plain_left(k, groups):
    """Characters before each n-gram that does not begin its word."""
    seen = {}
    for text, g in ROWS:
        for w in text.split() if g in groups else []:
            s = f"\2{w}\3"
            for i in range(1, len(s) - k + 1):
                seen.setdefault(s[i : i + k], set()).add(s[i - 1])
    return {gram: len(before) for gram, before in seen.items()}


def _hash(gram):
    return char_grams([gram], len(gram))[2][len(gram)][len(gram)]  # the first character of the joined words is BEGIN


def test_continuation_counts_equal_plain_ones(spark):
    k, gram, _, _, start, left = _counts(spark)
    for column, gone in enumerate(WITHOUT):
        for size in (1, 2, 3):
            got = {h: n for h, n in zip(gram[(k == size) & ~start], left[(k == size) & ~start][:, column], strict=True) if n}
            plain = _plain_left(size, {0, 1, 2, 3} - set(gone))
            assert len(got) == len(plain)
            assert all(got[_hash(x)] == n for x, n in plain.items() if "\3" not in x)


def test_both_classes_back_off_to_the_same_counts(spark):
    k, gram, context, counts, start, left = _counts(spark)
    by_class = np.stack([counts[:, :2].sum(axis=1), counts[:, 2:].sum(axis=1)], axis=1)
    models = CharModels(k, gram, context, kneser_ney(k, by_class, start, left[:, 0]))
    known, unknown, foreign = models.log_likelihoods(["stay", "qqabcq", "qqqqqq"])
    assert known[0] > known[1] + 1  # of class 0 alone
    assert unknown[0] > foreign[0]  # "ab" and "bc" are known, but not after this beginning ...
    assert np.isclose(unknown[0] - unknown[1], foreign[0] - foreign[1])  # ... so they speak for neither class
    lower = (k < 4) & ~start
    shared = kneser_ney(k, by_class, start, left[:, 0])
    assert (shared[lower, 0] == shared[lower, 1]).all() and (shared[~lower] == by_class[~lower]).all()
