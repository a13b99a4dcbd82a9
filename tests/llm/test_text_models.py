"""Toxicity, language identification, quality rules."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kiln.llm import decontaminate
from kiln.llm import lang_viterbi as L
from kiln.llm import rule_ledger as R
from kiln.llm import toxicity as T
from kiln.llm.queries import QUERIES
from kiln.llm.words import Hasher, find_words, text_slices
from tests.conftest import SF01

SF1 = "/root/testdata/sf0.1"


def test_words_of_slices_equal_bytes_split():
    texts = ["a b\tc", "", None, " \n ", "é ü x", "end", "no\x0bspace\x0cat\rall", "x" * 50]
    arr = pa.array(texts)
    for limit in (1, 8, 10_000):
        words = []
        for _, _, data, offsets in text_slices(arr, limit):
            w = find_words(data, offsets)
            raw = data.tobytes()
            words += [[raw[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] for a, b in zip(w.first, w.first[1:], strict=False)]
        assert words == [(t or "").encode().split() for t in texts]
    assert [x[:2] for x in text_slices(arr.slice(4, 2), 10_000)] == [(0, 2)]


def test_hashes_depend_on_bytes_only():
    data = np.frombuffer(b"abc abc abd bc ab c", np.uint8)
    w = find_words(data, np.array([0, len(data)]))
    h = Hasher(data)(w.starts, w.ends).tolist()
    assert h[0] == h[1] and len(set(h)) == 5
    long = np.frombuffer(b"x" * 300 + b" " + b"x" * 300 + b" " + b"x" * 299 + b"y", np.uint8)
    w = find_words(long, np.array([0, len(long)]))
    h = Hasher(long)(w.starts, w.ends).tolist()
    assert h[0] == h[1] != h[2]
    assert len(Hasher(data[:0])(np.zeros(0, int), np.zeros(0, int))) == 0
    assert len({*Hasher(np.full(600, 97, np.uint8))(np.zeros(600, int), np.arange(600)).tolist()}) == 600


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [2**k for k in (4, 8, 10, 12, 14)])
def test_constructed_texts_do_not_collide(n):
    from kiln.llm import fast_minhash, rule_ledger

    one, two = thue_morse(n), thue_morse(n, "b", "a")
    arrays = lambda *texts: next(text_slices(pa.array(list(texts)), 1 << 24))[2:]
    data, offsets = arrays(one, two)
    assert len(set(Hasher(data)(offsets[:-1], offsets[1:]).tolist())) == 2
    assert rule_ledger.measure_texts(*arrays(f"{one}\n{two}"))["n_dup_lines"].tolist() == [0]
    key, first = fast_minhash.shingle_sets(*arrays(f"{one} x", f"{two} x"), 2)
    assert len(set(key.tolist())) == 2 and first.tolist() == [0, 1, 2]
    h, _ = decontaminate.word_hashes(*arrays(one, two))
    assert len(set(h.tolist())) == 2


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_toxicity_on_held_out_labels(spark):
    rows = QUERIES["op1_kneser_ney_toxicity"](spark, SF1).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in label]
    y = np.array([label[r.doc_id] for r in held])
    s = np.array([r.score for r in held])
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert auc(s, y) > 0.94 and ((s >= 0.5) == y).mean() > 0.97 and (s[y == 0] >= 0.5).mean() < 0.01


def test_toxicity_sees_no_held_out_label(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id"), 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(str, T.score_toxicity(docs, x).select("doc_id", "toxic_score").collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (4, 1), (7, 1), (None, 1), (3, None), (99, 1), (10, 0), (10, 1)], "doc_id long, toxic int")
    got = T.score_toxicity(edge_docs, labels)
    rows = got.collect()
    assert len(rows) == 12 and all(0 <= r.toxic_score <= 1 for r in rows) and rows[0]["rank"] == "clash"
    assert len({r.toxic_score for r in rows if r.doc_id == 7}) == 1
    assert {r.toxic_score for r in rows if not (r.text or "").strip()} == {next(r.toxic_score for r in rows if r.doc_id == 2)}
    assert T.score_toxicity(no_docs, labels).count() == 0
    none = T.score_toxicity(edge_docs, labels.limit(0)).collect()
    assert {r.toxic_score for r in none} == {0.25}


def plain_viterbi(scores, penalty):
    v, back = np.zeros(scores.shape[1]), []
    for x in scores:
        best = v.argmax()
        jump = v[best] - penalty
        back.append(np.where(jump > v, best, np.arange(len(v))))
        v = np.maximum(v, jump) + x
    label, out = v.argmax(), []
    for b in back[::-1]:
        out.append(label)
        label = b[label]
    return out[::-1]


def test_block_viterbi_equals_plain_recursion():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = rng.integers(0, 150, 5)
        first = np.concatenate([[0], np.cumsum(n)])
        s = np.round(rng.normal(0, 3, (first[-1], 4)), 3)
        got = L.viterbi(s, first, 2.0)
        assert all(got[a:b].tolist() == plain_viterbi(s[a:b], 2.0) for a, b in zip(first, first[1:], strict=False))


def test_language_on_held_out_documents(spark):
    rows = QUERIES["op7_lang_viterbi"](spark, SF01).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.99


def test_language_spans_and_scripts(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text", "lang")
    learn = docs.unionByName(spark.createDataFrame([(10**6 + i, "привет мир как дела сегодня", "ru") for i in range(50)], docs.schema))
    en = docs.where("lang = 'en'").first().text.split()[:40]
    de = docs.where("lang = 'de'").first().text.split()[:40]
    text = " ".join(en + de + ["Кошка"] * 5)
    r = L.identify(spark.createDataFrame([(text,)], "text string"), learn).first()
    assert [s.lang for s in r.lang_spans] == ["en", "de", "ru"]
    assert abs(r.lang_spans[1].start - 40) <= 3 and r.lang_spans[-1].end == 85


def test_language_edges(spark, edge_docs, no_docs):
    rows = L.identify(edge_docs, edge_docs).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 12 and rows[0]["rank"] == "clash"
    assert all(got[i].lang_pred == "und" and got[i].lang_score == 0 for i in (2, 3, 6, 9))
    assert got[1].lang_pred in ("en", "de") and L.identify(no_docs, edge_docs).count() == 0
    assert {r.lang_pred for r in L.identify(edge_docs, no_docs).collect()} == {"und"}


def plain_measures(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {w: windows.count(w) for w in set(windows)} if len(windows) < 3000 else {}
    hit = {j for i, w in enumerate(windows) if count.get(w, 0) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_of_hard_texts(spark):
    texts = ["a b c d e f g h " * 3, "one two\none two\n\n \none two", "é ü x #<>", None, "", "a b c d e f g h\na b c d e f g h", "|" * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.measure(df).collect()}
    assert got == {i: plain_measures(t) for i, t in enumerate(texts)}


def test_rules_keep_good_and_reject_bad(spark):
    rows = QUERIES["op10_rule_ledger"](spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert all(r.kept for r in good) and sum(r.kept for r in rows if r.quality == 0) <= 2


def test_policies_and_ablation_from_the_ledger(spark, edge_docs, no_docs):
    led = R.ledger(edge_docs)
    rows = led.collect()
    assert len(rows) == 12 and R.ledger(no_docs).count() == 0
    mask = R.policy_mask("web-2")
    want = {}
    for k, (name, _) in enumerate(R.RULES):
        bits = [r.failures & mask for r in rows]
        want[name] = (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))
    assert {r.rule: (r.fails, r.fails_alone) for r in R.ablation(led, "web-2").collect()} == want
    kept = {v: led.where(R.passes(v)).count() for v in R.POLICIES}
    assert kept["base-1"] >= kept["web-1"] >= kept["web-2"]
    assert all(r.with_all is None for r in R.ablation(R.ledger(no_docs), "web-2").collect())


def test_word_tables_forget_only_the_oldest():
    from kiln.llm.scoring import WordTable

    asked = []

    def compute(words):
        asked.extend(words)
        return np.array([[len(w), w[0]] for w in words], float)

    t = WordTable(2, compute, most=20 * (WordTable.ENTRY + 8 + 4))
    texts = lambda lo, hi: [b" ".join(b"%04d" % i for i in range(k, k + 5)) for k in range(lo, hi, 5)]
    rng = np.random.default_rng(1)
    for _ in range(200):
        lo = int(rng.integers(0, 60)) * 5
        rows, first = t.of([*texts(lo, lo + 10), b"", b"often often"])
        assert rows[:, 0].tolist() == [4.0] * 10 + [5.0, 5.0] and first.tolist() == [0, 5, 10, 10, 12]
        assert len(t.place) <= 40 and len(t.old_place) <= 40
    assert asked.count(b"often") == 1 and len(asked) > 300


def test_word_tables_take_few_bytes_a_word():
    import tracemalloc

    from kiln.llm.scoring import FRESH_BYTES, WordTable

    most = []

    def compute(words):
        most.append(sum(map(len, words)))
        return np.array([int(w) for w in words], float)

    t = WordTable(1, compute)
    tracemalloc.start()
    try:
        for lo in range(0, 300_000, 20_000):
            rows, _ = t.of([b" ".join(b"%08d" % i for i in range(lo, lo + 20_000))])
            assert rows[:, 0].tolist() == list(range(lo, lo + 20_000))
        del rows
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 10 << 20  # as a dictionary of words: 32 MB
    assert max(most) <= FRESH_BYTES + 8
    rows, first = t.of([b"00000007 00299999", b"", b" 00000007"])
    assert rows[:, 0].tolist() == [7, 299_999, 7] and first.tolist() == [0, 2, 2, 3] and len(t.place) == 300_000


def test_viterbi_in_longer_blocks_is_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    scores, first = rng.normal(0, 4, (900, 5)), np.array([0, 700, 700, 900])
    want = L.viterbi(scores, first)
    monkeypatch.setattr(L, "MATRIX_BYTES", 900 * 25 * 8 // 100)
    assert (L.viterbi(scores, first) == want).all()


def test_no_gram_of_the_sample_is_dropped(spark):
    from kiln.llm.char_grams import gram_counts

    words = ["".join(chr(0x4E00 + int(c)) for c in row) for row in np.random.default_rng(3).integers(0, 9000, (3000, 6))]
    sample = spark.createDataFrame([(" ".join(words[k : k + 100]), k // 100 % 2) for k in range(0, 3000, 100)], "text string, group int")
    k, _, _, counts = gram_counts(sample, 2, 4)
    want = {n: {w[max(i, 0) : i + n] if i >= 0 else "^" + w[: i + n] for w in ("^" + x + "$" for x in words) for i in range(len(w) - n + 1)} for n in (2, 3, 4)}
    assert all((k == n).sum() == len(want[n]) for n in want)
    assert (counts.sum(axis=1) > 0).all()
