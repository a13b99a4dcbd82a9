"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from kiln.llm import gram_index as G
from tests.llm.test_corpus import LOWER


def cuts(word):
    return [(i, word[:i] + word[i + 1 :]) for i in range(len(word))]


def plain(words, times=10):
    """word -> (form, root, n, n_near, form_n), by the words that one deletion gives."""
    by_cut, near = {}, {w: set() for w in words}
    for w in words:
        for cut in cuts(w):
            by_cut.setdefault(cut, []).append(w)
        for _, shorter in cuts(w):
            if shorter in near:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_cut.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, words):
    rows = [(w, n, "clash", 1) for w, n in words.items()]
    return spark.createDataFrame(rows, "word string, n long, form string, key int")


def check(spark, words, **more):
    got = result(G.spelling_variants(frame(spark, words), **more))
    assert got == plain(words)
    return got


def edited(rng, word, letters):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    return word[:i] + (rng.choice(letters) if kind else "") + word[i + (kind != 1) :]


def test_words_of_few_letters_in_long_lists(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(4, 11))): rng.choice([1, 2, 3, 40, 700]) for _ in range(4000)}
    got = check(spark, words, dictionary=300)
    assert max(v[3] for v in got.values()) > 8 and any(v[1] not in (k, v[0]) for k, v in got.items())


def test_edits_at_every_place_and_long_words(spark):
    rng = random.Random(5)
    words = {}
    for size in (4, 5, 6, 7, 8, 9, 12, 20, 46, 47, 48, 49, 50, 53, 54, 55, 56, 80, 400):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzàÿ日") for _ in range(size))
        words[word] = 1000
        for i in {*range(0, size + 1, 1 + size // 60), size - 1, size}:
            for other in (word[:i] + "x" + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + "ö" + word[i:]):
                if len(other) >= 4:
                    words.setdefault(other, rng.randrange(1, 120))
    check(spark, words)
    check(spark, words, dictionary=20)


def test_a_third_of_the_words_share_their_beginning(spark):
    rng = random.Random(6)
    words = {"aaaaaa" + "".join(rng.choice("bcdefghij") for _ in range(5)): rng.randrange(1, 50) for _ in range(1500)}
    words |= {edited(rng, rng.choice(list(words)), "abcxyz"): 2 for _ in range(1500)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(7)): 3 for _ in range(1500)}
    check(spark, words, dictionary=100)


def test_short_words_nulls_and_no_words(spark):
    words = {"a": 1, "ab": 50, "": 3, "abc": 4, "word": 1, "wort": 20}
    got = result(G.spelling_variants(frame(spark, words)))
    assert got == {"a": (None, "a", 1, 0, None), "ab": (None, "ab", 50, 0, None), "": (None, "", 3, 0, None),
                   "abc": (None, "abc", 4, 0, None), "word": ("wort", "wort", 1, 1, 20), "wort": (None, "wort", 20, 1, None)}
    null = spark.createDataFrame([(None, 3)], "word string, n long")
    assert [tuple(r) for r in G.spelling_variants(null).collect()] == [(None, None, None, 3, 0, None)]
    assert G.spelling_variants(frame(spark, words).limit(0)).count() == 0


def plain_counts(docs, least, drop):
    seen = Counter()
    for doc_id, text in docs:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if h % drop == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                seen[word] += 1
    return dict(seen)


def test_runs_equal_brute_force(spark, edge_docs, no_docs):
    more = spark.createDataFrame([(50, "Naïve×÷Ünder Ā Ļatvia StraßeÀÿĀabcdefgh ABCDEFGHÉ" * 40), (51, "é" * 9 + "퟿")], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more).unionByName(more.withColumn("doc_id", F.col("doc_id") + 7))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for drop in (2, 31):
        got = {r.word: r.n for r in G.count_runs(docs, 7, drop).collect()}
        assert got == plain_counts(rows, 7, drop)
    assert G.count_runs(no_docs, 7, 31).count() == 0
