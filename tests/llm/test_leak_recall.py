"""What decontamination must not lose: weak cosines and exact copies of short or common passages."""

import numpy as np
import pytest

from kiln.llm.decontaminate import COSINE, SHORT, Finder, Passage, Vocabulary, find_leaks, word_hashes


def _hashes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(data, np.array([0, len(data)]))[0]


def _finder(items, idf, other=1.0):
    """A finder whose latent space is the whole space of the words, each of weight ``idf``."""
    passages = [Passage(i, _hashes(t)) for i, t in enumerate(items)]
    words = Vocabulary(np.array([w for p in passages for w in p.words], np.uint64))
    affinity = np.zeros((len(words.hashes), len(passages)), np.float32)
    for i, p in enumerate(passages):
        at, n = np.unique(words.find(np.array(p.words, np.uint64)), return_counts=True)
        vector = (1 + np.log(n)) * idf
        affinity[at, i] = idf * vector / np.linalg.norm(vector)
    return Finder(words, np.full(len(words.hashes), idf), other, affinity, passages)


def _leaks(finder, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return finder(data, np.array([0, len(data)]))[0][0]


def test_windows_of_cosine_above_a_fifth_are_confirmed():
    finder = _finder(["a b c d e f g h"], 0.6)
    text = " ".join([*[f"x{i}" for i in range(12)], "a b c d e changed g h", *[f"y{i}" for i in range(12)]])
    (leak,) = _leaks(finder, text)
    assert leak["item_id"] == 0 and leak["lcs"] == 7 / 8
    assert 0.2 <= leak["cosine"] < 0.3


@pytest.mark.parametrize("size", [1, 2, 3, 6, 12, 14])
def test_exact_copies_are_found_whatever_their_cosine(size):
    item = " ".join(f"w{i}" for i in range(size))
    finder = _finder(["other words", item, item], 0.02)
    for before in (0, 1, 16, 57):
        text = " ".join([*[f"x{i}" for i in range(before)], item, *[f"y{i}" for i in range(100)]])
        found = finder.words.find(_hashes(text))
        assert not any((cosine >= COSINE).any() for *_, cosine in finder.windows(np.array([0, len(found)]), found))
        assert [(x["item_id"], x["lcs"], x["word"]) for x in _leaks(finder, text)] == [(1, 1.0, before), (2, 1.0, before)]
    if 1 < size < SHORT:
        assert _leaks(finder, " ".join([*[f"w{i}" for i in range(size - 1)], *[f"y{i}" for i in range(100)]])) == []


def test_copies_do_not_cross_texts():
    finder = _finder(["a b", "c"], 0.02)
    data = np.frombuffer(b"x aab c", np.uint8)
    assert [[x["item_id"] for x in leaks] for leaks in finder(data, np.array([0, 3, 5, 7]))[0]] == [[], [], [1]]


def test_short_items_of_common_words_are_found_in_long_documents(spark):
    """Words that stand in nearly all documents weigh almost nothing beside rare neighbours."""
    rare = lambda d, n: " ".join(f"r{d}x{i}" for i in range(n))
    rows = [(d, f"{rare(d, 60)} of it the {rare(d + 1000, 60)}") for d in range(40)]
    rows += [(100, f"{rare(100, 70)} the it of {rare(101, 50)}"), (101, rare(102, 120))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, "the it of"), (2, "of it"), (3, "of it the"), (4, rare(5000, 12))], "item_id long, text string")
    got = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"]) for r in find_leaks(docs, items).collect()}
    assert got == {d: [2, 3] for d in range(40)} | {100: [1], 101: []}
