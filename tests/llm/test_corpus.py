"""Near-duplicates, decontamination, token files, the pipeline."""

import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kiln.llm import bitplane_tokens as B
from kiln.llm import decontaminate as D
from kiln.llm import components as K
from kiln.llm import fast_minhash as N
from kiln.llm.common import materialise
from kiln.llm.components import connected_components
from kiln.llm.queries import QUERIES
from kiln.session import shared_dir
from tests.conftest import SF01

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_groups(docs, width, percent=80):
    """doc_id -> (set size, smallest id reachable), by brute force over an inverted index."""
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            index[x].append(d)
    for a in sorted(sets):
        shared = defaultdict(int)
        for x in sets[a]:
            for b in index[x]:
                if b > a:
                    shared[b] += 1
        for b, n in shared.items():
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_near_duplicates_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    want = plain_groups(docs, 2)
    rows = QUERIES["op5_fast_minhash"](spark, SF01).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_large_group_of_near_copies(spark):
    """Copies with up to a third of the words changed: chains, members that reach the group only through others, and near misses."""
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    docs = []
    for i in range(400):
        words = list(base if i % 2 or not docs else rnd.choice(docs)[1].split())
        for _ in range(rnd.choice([0, 1, 2, 5, 10, 15, 20, 30])):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(5000)}"
        docs.append((1000 - i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, width=2).collect()}
    assert got == plain_groups(docs, 2)


def test_pivot_bound_never_excludes_a_link():
    rng = np.random.default_rng(2)
    for _ in range(3000):
        p, x, y = (set(rng.choice(40, rng.integers(5, 35), replace=False).tolist()) for _ in range(3))
        both = len(x & y)
        less, more = (len(p - x), len(p - y)), (len(x - p), len(y - p))
        most = len(p) - sum(less) + min(less) + min(more)
        assert most >= both


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.concatenate([a[: len(a) // 2], np.unique(rng.integers(0, 2**63, len(a) - len(a) // 2, dtype=np.uint64))])
        bins = N.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 1024)
        assert (bins != N._EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((bins[0] == bins[1]).mean() - true) < 0.08
    empty = N.sketch(np.zeros(0, np.uint64), np.array([0, 0]))
    assert (empty == N._EMPTY).all()


def test_near_duplicate_edges(edge_docs, no_docs):
    rows = N.near_duplicates(edge_docs).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.component_id, r.kept))
    assert len(rows) == 12 and got[5] == {(4, False)} and got[4] == {(4, True)} and got[7] == {(7, True)}
    assert got[2] == {(2, True)} and got[3] == {(3, True)} and got[None] == {(None, True)}
    assert N.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, 100 + i) for i in range(40)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[500] == 100 and got[901] == 900
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nodes_are_not_repeated_for_their_edges(spark, monkeypatch):
    """Hot nodes are broadcast; no node's row is repeated, whatever its number of edges."""
    monkeypatch.setattr(K, "HOT", 3)
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(150)] + [(1000, 1001 + i) for i in range(50)] + [(1020, 5)]
    frame = spark.createDataFrame(links, "u long, v long")
    top = {x: x for e in links for x in e}
    for _ in top:
        for u, v in links:
            top[u] = top[v] = min(top[u], top[v])
    assert {r.id: r.component for r in connected_components(frame).collect()} == {x: c for x, c in top.items() if any(x in e for e in links if e[0] != e[1])}
    edges = frame.where("u > v").distinct()
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n"))
    joined = K._with_low(edges, low, 3)
    assert joined.count() == edges.count()
    assert "Generate" not in joined._jdf.queryExecution().toString()


def words_of(text):
    return re.findall(r"\w+", text.lower())


def test_leaks_of_the_given_benchmark(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").collect()
    bench = {r.item_id: words_of(r.text) for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()}
    index = defaultdict(set)
    for i, w in bench.items():
        for j in range(len(w) - 4):
            index[tuple(w[j : j + 5])].add(i)
    truth = set()
    for r in docs:
        w, seen = words_of(r.text), defaultdict(set)
        for j in range(len(w) - 4):
            for i in index.get(tuple(w[j : j + 5]), ()):
                seen[i].add(tuple(w[j : j + 5]))
        truth |= {(r.doc_id, i) for i, s in seen.items() if len(s) >= 0.5 * (len(bench[i]) - 4)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_latent_decontamination"](spark, SF01).collect()}
    assert got == truth


def test_paraphrases_recall_and_clean_documents(spark):
    """A quarter of the words replaced or dropped: latent retrieval finds nearly all that the plain comparison finds."""
    rnd = random.Random(9)
    items = spark.read.parquet(f"{SF01}/benchmark.parquet").collect()
    rest = [r.text.split() for r in spark.read.parquet(f"{SF01}/documents.parquet").where("lang = 'en'").limit(150).collect()]
    rows, planted = [], set()
    for k, r in enumerate(items * 3):
        words = r.text.split()
        for _ in range(len(words) // 6):
            words[rnd.randrange(len(words))] = rnd.choice(rnd.choice(rest))
        del words[rnd.randrange(len(words))]
        around = rnd.choice(rest)
        cut = rnd.randrange(len(around) + 1)
        rows.append((k, " ".join(around[:cut] + words + around[cut:]).upper() if k % 2 else " ".join(around[:cut] + words + around[cut:])))
        passage = D.Passage(r.item_id, np.array([hash(w) & 0xFFFF_FFFF for w in words_of(r.text)], np.uint64))
        if passage.confirm([hash(w) & 0xFFFF_FFFF for w in words_of(" ".join(words))])[2]:
            planted.add((k, r.item_id))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.find_leaks(docs, spark.read.parquet(f"{SF01}/benchmark.parquet")).select("doc_id", F.explode("leaks").alias("x"))
    got = {(r.doc_id, r.x.item_id) for r in found.collect()}
    assert len(planted) > 60 and len(got & planted) >= 0.9 * len(planted)
    clean = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rest)], "doc_id long, text string")
    flagged = D.find_leaks(clean, spark.read.parquet(f"{SF01}/benchmark.parquet")).where(F.size("leaks") > 0).count()
    assert flagged <= 6  # some documents hold benchmark passages


def test_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert D.lcs(D.Passage._places(a), len(a), b) == table[-1][-1]


def test_distributed_and_local_products_agree(spark):
    rng = np.random.default_rng(4)
    rows = [(np.sort(rng.choice(300, 9, replace=False)).astype(np.int32), rng.normal(size=9).astype(np.float32)) for _ in range(500)]
    dense = np.zeros((500, 300))
    for i, (w, x) in enumerate(rows):
        dense[i, w] = x
    basis = rng.normal(size=(300, 20)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(w.tolist(), x.tolist()) for w, x in rows], "word array<int>, weight array<float>").repartition(5)
    for small, want in ((False, dense.T @ dense @ basis), (True, basis.T @ dense.T @ dense @ basis)):
        assert np.allclose(D.gram_products(frame, basis, small), want, atol=1e-3)
        assert np.allclose(D._gram(rows, basis, small), want, atol=1e-3)


@pytest.mark.parametrize("cells", [1 << 24, 300])
def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch, cells):
    """Every passage of every document counts, in one pass or, with more words than ``CELLS`` allows, in several."""
    monkeypatch.setattr(D, "CELLS", cells)
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([0, 1, 5, 64, 65, 300]))) for _ in range(5000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "unknown words"])], "doc_id long, text string").repartition(3)
    data = np.frombuffer(" ".join(f"w{i}" for i in range(30)).encode(), np.uint8)
    names = D.word_hashes(data, np.array([0, len(data)]))[0]
    words, idf = D.Vocabulary(names), np.linspace(0.1, 3, 30)
    number = {f"w{i}": int(k) for i, k in enumerate(words.find(names))}
    rows = []
    for text in texts:
        w = text.split()
        for a in range(0, len(w), D.PASSAGE):
            found = np.array([number.get(x, -1) for x in w[a : a + D.PASSAGE]])
            rows += D.rows_of(found, np.array([0, len(found)]), idf)
    dense = np.zeros((len(rows), 30))
    for i, (at, x) in enumerate(rows):
        dense[i, at] = x
    basis = np.random.default_rng(1).normal(size=(30, 7))
    gram = D.gram_matrix(D.corpus_rows(docs, words, idf), 30)
    assert np.allclose(D.gram_times(gram, basis), dense.T @ dense @ basis, rtol=1e-4, atol=1e-2)
    assert abs(gram.agg(F.sum("own")).first()[0] - len(rows)) < 0.01 * len(rows) ** 0.5


@pytest.mark.parametrize("cells", [1 << 24, 300])
def test_passages_are_summed_in_the_worker_that_makes_them(spark, monkeypatch, cells):
    """A task of two Python maps holds two workers, which stay with their memory for later stages."""
    monkeypatch.setattr(D, "CELLS", cells)
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, name)

    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(40)}" for _ in range(rnd.choice([0, 5, 64, 65, 300]))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string").repartition(3)
    data = np.frombuffer(" ".join(f"w{i}" for i in range(30)).encode(), np.uint8)
    words, idf, basis = D.Vocabulary(D.word_hashes(data, np.array([0, len(data)]))[0]), np.linspace(0.1, 3, 30), np.eye(30)
    want = D.gram_times(D.gram_matrix(D.corpus_rows(docs, words, idf), 30), basis)
    got = D.gram_times(D.gram_matrix(docs.select("text"), 30, D.passage_rows(words, idf)), basis)
    assert got.any() and np.allclose(got, want, rtol=1e-5, atol=1e-4)
    monkeypatch.setattr(D, "CELLS", 1 << 24)
    monkeypatch.setattr(D, "materialise", written)
    D.find_leaks(docs, spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string"))
    assert plans and all(p.count("MapInArrow") <= 1 for p in plans)


@pytest.mark.parametrize(("low", "high", "size"), [(0, 7, 7), (2, 5, 7), (5, 7, 7), (0, 1, 1)])
def test_gram_sums_take_half_a_matrix(low, high, size):
    places = D.line_places(low, high, size)
    cells = [places[i] + j for i in range(low, high) for j in range(i, size)]
    assert cells == list(range(places[high - 1] + size))
    assert all(places[i] + j < 0 for i in range(size) if not low <= i < high for j in range(size))
    rows = [np.sort(np.random.default_rng(k).choice(size, size // 2 + 1, replace=False)) for k in range(20)]
    first, out, want = np.cumsum([0, *map(len, rows)]), np.zeros(len(cells)), np.zeros((size, size))
    weight = np.linspace(1, 2, first[-1])
    D.add_pairs(out, places, np.concatenate(rows), weight, first)
    for a, b, r in zip(first[:-1], first[1:], rows, strict=True):
        want[np.ix_(r, r)] += np.outer(weight[a:b], weight[a:b])
    assert np.allclose(out, np.concatenate([want[i, i:] for i in range(low, high)]))


def test_latent_space_spans_the_leading_directions(spark):
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(80, 12, replace=False)).astype(np.int32), rng.normal(size=12).astype(np.float32)) for _ in range(30)]
    empty = spark.createDataFrame([], "word array<int>, weight array<float>")
    space = D.latent_space(rows, empty, 80, rank=30)
    dense = np.zeros((30, 80))
    for i, (w, x) in enumerate(rows):
        dense[i, w] = x
    assert np.allclose(dense @ space @ space.T, dense, atol=1e-3)


def test_decontamination_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame(
        [(1, "the dog sat on the log by the old red barn"), (2, None), (3, ""), (4, "one"), (None, "a row without an id"), (5, "!!")],
        "item_id long, text string",
    )
    rows = D.find_leaks(edge_docs, bench).collect()
    leaks = defaultdict(set)
    for r in rows:
        leaks[r.doc_id] |= {x.item_id for x in r.leaks}
    assert len(rows) == 12 and leaks[1] == {1} and leaks[7] == {4} and leaks[None] == {None} and not leaks[4] and not leaks[8]
    assert D.find_leaks(no_docs, bench).count() == 0
    assert all(r.leaks == [] for r in D.find_leaks(edge_docs, bench.limit(0)).collect())


def plain_tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = {}, 0
    for d, t in sorted(docs):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out[d] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_files_equal_plain_encoding(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_bitplane_tokens"](spark, SF01).collect()}
    assert got == plain_tokens(docs)


def test_word_encoder_on_hard_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = B.WordEncoder("word_bpe_49k.json")
    for s in ["a<|endoftext|>b <|startoftext|> x", "ΑΣ ΑΣΑ Σ", "é ́a b c\x1cd\x85f", "it's WE'LL 12345 ...!!", "日本語 \r\n\x0b\x0c", "", "İstanbul"]:
        assert np.frombuffer(encoder.encode([s.encode()], None)[0], "<u4").tolist() == tokenizer.encode(s, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [False, True])
def test_bitplane_file_round_trip(bits):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 2**32, rng.integers(0, 400), dtype=np.uint32) for _ in range(20)]
    out = io.BytesIO()
    w = B.Writer(out, 100, bits)
    for i, x in enumerate(docs):
        w.add(None if i == 3 else i, x.astype("<u4").tobytes())
    w.close()
    r = B.Reader(out, len(out.getvalue()))
    back = list(r.documents())
    assert [d for d, _, _ in back] == [None if i == 3 else i for i in range(20)]
    assert [b"".join(p) for _, _, p in back] == [x.tobytes() for x in docs]
    whole = np.concatenate(docs)
    assert (r.ids(137, 500) == whole[137:637]).all() and (r.ids(0, len(whole)) == whole).all() and len(r.ids(5, 0)) == 0
    with pytest.raises(ValueError):
        B.Reader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)


def test_token_file_edges(spark, edge_docs, no_docs):
    path = shared_dir(spark, "llm", "edge-tokens")
    manifest = B.write_tokens(edge_docs, path)
    rows = sorted(B.read_tokens(manifest, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10]
    assert [r.start for r in rows][1:] == list(np.cumsum([r.n_tokens for r in rows])[:-1])
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 6)} == {1}
    again = B.read_tokens(B.write_tokens(edge_docs, path), path)  # a repeated write replaces its files
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    assert B.tokens_of(no_docs).count() == 0


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF01), name)
        kept[name] = docs
        if name != "token-files":
            assert docs.columns == before.columns
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    first = [(i, texts[i]) for i in ids["toxicity"]]
    assert sorted(ids["near-dedup"]) == sorted(d for d, (_, top) in plain_groups(first, 5).items() if d == top)
    leaked = {r.doc_id for r in QUERIES["op4_latent_decontamination"](spark, SF01).collect()}
    assert sorted(ids["decontamination"]) == sorted(set(ids["near-dedup"]) - leaked)
    taken = ids["mixing"]
    assert set(taken) <= set(ids["decontamination"]) and max(map(taken.count, set(taken))) <= 2
    assert sorted(ids["token-files"]) == sorted(taken)
    assert corpus_pipeline.run(spark, SF01).count() == len(taken)


def test_pipeline_stages_on_edges(spark, edge_docs, no_docs, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{SF01}/{t}.parquet", tmp_path / f"{t}.parquet")
    for docs, most in ((edge_docs, 24), (no_docs, 0)):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "size", "kept")
        for name, stage in corpus_pipeline.STAGES:
            docs = materialise(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() <= most


@pytest.mark.parametrize("vocabulary", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_tokenizer(vocabulary):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["hello world  again", "", " \n\t ", "Ünïcode naïve, Straße. <|endoftext|> x", "日本語 テキスト no break", "a.b,c..  DON'T 123 4567", "tab\tand\nline " * 50]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    got = B.WordEncoder(vocabulary).encode([t.encode() for t in texts], None)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
