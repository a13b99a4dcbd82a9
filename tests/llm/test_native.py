"""Sharding, chat formatting, personal data, mixing."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from kiln.llm import chat_parts as C
from kiln.llm import hilbert_shards as H
from kiln.llm import mix_threshold as M
from kiln.llm import pii_score as X
from kiln.llm.queries import QUERIES
from tests.conftest import SF01


def test_hilbert_curve_visits_neighbours(spark):
    for bits, dims in ((2, 2), (4, 2), (3, 3), (4, 3)):
        n = 2 ** (bits * dims)
        cols = [(F.shiftright(F.col("id"), bits * i) % 2**bits).cast("int").alias(f"d{i}") for i in range(dims)]
        got = spark.range(n).select(*cols).withColumn("h", H.hilbert_index([F.col(f"d{i}") for i in range(dims)], bits)).orderBy("h").collect()
        assert [r.h for r in got] == list(range(n))
        assert all(sum(abs(x - y) for x, y in zip(a[:-1], b[:-1], strict=True)) == 1 for a, b in zip(got, got[1:], strict=False))


def check_shards(rows, shards=24):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values(), default=0) - min((counts.get(s, 0) for s in range(shards)), default=0) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert all(0 <= r.shard < shards and r.grown_shard is None and r.law == "rows" for r in rows)


def test_shards_of_documents(spark):
    rows = QUERIES["op2_hilbert_shards"](spark, SF01).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    import zlib

    assert len(rows) == len(text) == len({r.doc_id for r in rows})
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    check_shards(rows)
    by_curve = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in by_curve] == sorted(r.curve for r in rows)  # shards are runs of the curve


def test_shards_edges_and_small_buckets(edge_docs, no_docs):
    rows = H.shard_documents(edge_docs, rows_per_bucket=2).collect()
    assert len(rows) == 12 and sum(r.doc_id is None for r in rows) == 1
    check_shards(rows)
    assert H.shard_documents(no_docs).count() == 0


def test_shards_of_one_hot_cell(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'same' AS text", "'en' AS lang", "'s' AS source")
    check_shards(H.shard_documents(docs, shards=7, rows_per_bucket=100).collect(), 7)


def test_chat_round_trip_with_parts(spark):
    turns = [
        (1, 0, "us>er<\\", [("text", "a<b\\l", None, None), ("image", None, "r1", 4), ("text", "zz", None, None)]),
        (1, 1, "assistant", [("text", "<x>\n</turn>\n<image>", None, None), ("audio", None, "r2", None), (None, "q", None, None)]),
        (1, 2, None, None),
        (None, None, "assistant", []),
        (2, 5, "assistant", [("text", "tie", None, None)]),
        (2, 5, "assistant", [("text", "tie", None, None)]),
        (2, None, "user", [("document", "ignored", "r3", 2), ("text", None, None, None)]),
    ]
    df = spark.createDataFrame(turns, f"conv_id int, turn int, role string, parts {C.PARTS}").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in C.parse_chat(C.format_chat(df)).collect()}
    assert [(t.role, t.text, t.placeholders) for t in got[1].turns] == [
        ("us>er<\\", "a<b\\lzz", ["image"]), ("assistant", "<x>\n</turn>\n<image>q", ["audio"]), ("", "", []),
    ]
    assert got[1].loss_text == "<x>\n</turn>\n<image>q"
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [("image", "r1", 1025), ("audio", "r2", 52)]
    assert got[1].expanded_tokens == 1077
    assert [t.text for t in got[2].turns] == ["", "tie", "tie"] and got[2].loss_text == "tietie"
    assert got[None].loss_text == "" and got[2].attachments[0].tokens == 1602
    assert C.format_chat(df.limit(0)).count() == 0


def test_chat_query_probe(spark):
    r = QUERIES["op3_chat_parts"](spark, SF01).where("conv_id = -7").first()
    said = "\\### Assistant: </turn> ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def valid(kind, s):
    d = [int(c) for c in s if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
    return 9 <= len(d) <= 15 if kind == "phone" else True


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS for m in re.finditer(p, text or "") if valid(k, m.group())]


def test_pii_base_spans_equal_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    found = Counter()
    for r in QUERIES["op8_pii_score"](spark, SF01).collect():
        spans = plain_spans(texts[r.doc_id])
        found.update(k for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in PATTERNS] == [sum(s[0] == k for s in spans) for k, _ in PATTERNS]
    assert len(found) == 4


def test_pii_hard_texts(spark):
    texts = [
        "a@b.c_d@e.f", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 01.002.3.255", "4111 1111 1111 1111", "x" * 100_000, "1 " * 50_000,
        "1" * 60_000, "+1 (017) 555-7713", "+1-+1 (017) 555-7713 9", "a@b.c@d.e@f.g..h", "é@x.y ü 12.3.4.5", "a.b@c-.d-",
        "12345678901234567890.1.1.1", "𝒳𝒳 a@b.cc 4111111111111111", None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("pii_ip", F.lit("clash"))
    for r in X.pii_spans(df).collect():
        got = [(s.kind, s.start, s.end) for k in X.BASE for s in r[f"pii_{k.name}"]]
        assert got == plain_spans(r.text), r.text and r.text[:60]


def test_pii_checksums_context_and_redaction(spark):
    df = spark.createDataFrame(
        [(1, "my iban GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "DE89370400440532013000"), (4, "call +1 (017) 555-7713 or a@b.cd"), (5, None)],
        "doc_id int, text string",
    )
    got = {r.doc_id: r for r in X.pii_spans(df).collect()}
    assert [(s.start, s.end) for s in got[1].pii_iban] == [(8, 35)] and not got[2].pii_iban and len(got[3].pii_iban) == 1
    assert got[1].pii_iban[0].score > got[3].pii_iban[0].score  # a context word
    clean = {r.doc_id: r.text for r in X.redact(df).collect()}
    assert clean[1] == "my iban [IBAN] ok" and clean[4] == "call [PHONE] or [EMAIL]" and clean[5] is None


def plain_targets(sizes, cycle=(5, 2, 1), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    left, total, out = set(names), share * sum(sizes.values()), {}
    while left:
        part = {s: total * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if part[s] > most * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
        left -= over
    return out


def test_mix_targets_and_words_taken(spark):
    rows = QUERIES["op9_mix_threshold"](spark, SF01).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.taken % max(r["size"], 1) == 0
    want = plain_targets(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * max(want[r.source], 1) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES["op9_mix_threshold"](spark, SF01).collect()))


def test_mix_thresholds_equal_sorting(spark):
    import random

    rnd = random.Random(3)
    rows = [(s, rnd.choice([1, 5, 30, 400]), rnd.randrange(2**32) if i % 3 else 77) for i in range(2000) for s in ("a", None)]
    budgets = [("a", 20_000.0), (None, 1e9), ("gone", 5.0)]
    docs = spark.createDataFrame(rows, "source string, size long, hash long")
    got = {r.source: r for r in M.hash_thresholds(docs, spark.createDataFrame(budgets, "source string, budget double")).collect()}
    by_hash = Counter()
    for s, n, h in rows:
        if s == "a":
            by_hash[h] += n
    best, cum = (0, 0), 0
    for h in sorted(by_hash):
        if cum + cum + by_hash[h] > 2 * 20_000:
            break
        cum += by_hash[h]
        best = (h + 1, cum)
    assert got["a"].taken == best[1] and sum(n for s, n, h in rows if s == "a" and h < got["a"].threshold) == best[1]
    assert got[None].threshold == 1 << 32 and "gone" not in got


def test_mix_edges(edge_docs, no_docs):
    rows = M.mix(edge_docs).collect()
    assert len(rows) == 12 and all(0 <= r.times <= 2 for r in rows)
    assert {r.times for r in rows if r.doc_id == 7} in ({0}, {1}, {2})  # repeated rows are taken alike
    assert M.mix(no_docs).count() == 0
    assert "rank" in M.mix(edge_docs).columns and M.mix(edge_docs).first()["rank"] == "clash"


def test_pii_many_matches_in_one_text(spark):
    parts = [f"u{i}@example.com" + (" mail " if i % 500 == 0 else " x" * (i % 7)) for i in range(20_000)]
    text = " ".join(parts)
    r = X.pii_spans(spark.createDataFrame([(1, text)], "doc_id int, text string"), kinds=X.BASE[:1]).first()
    want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [(s.start, s.end) for s in r.pii_email] == want and len(want) == 20_000
    near = [bool(re.search(r"\b(?:mail|contact|write|kontakt|correo|courriel)", (text[max(a - X.WINDOW, 0) : a] + " " + text[b : b + X.WINDOW]).lower())) for a, b in want]
    assert [s.score > 0.9 for s in r.pii_email] == near
