"""Merkle manifest against plain recursion."""

import hashlib
import zlib

from pyspark.sql import functions as F

from kiln.llm import merkle_manifest as M
from kiln.llm.common import held_out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, row.n_chars + more if row.n_chars is not None else None, row.text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def paths(leaves):
    """(root, path of every leaf) of a list of digests; a path has (left, right) for each level."""
    out, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            first = at - at % 2
            out[i].append(("".join(level[first:at]), "".join(level[at + 1 : first + 2])))
        level, own = [digest(*level[k : k + 2]) for k in range(0, len(level), 2)], [at // 2 for at in own]
    return level[0], out


def plain(rows):
    """Sorted (id, leaf, subroot, root, proof, folded, verified)."""
    least = lambda x: (x is not None, x if x is not None else 0)
    langs = {}
    for r in rows:
        tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        langs.setdefault(r.lang, []).append((least(r.doc_id), leaf(r), leaf(r, int(tampered))))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: paths([x[1] for x in sorted(langs[k])]) for k in names}
    root, upper = paths([trees[k][0] for k in names])
    out = []
    for k, above in zip(names, upper, strict=True):
        for (key, own, claimed), path in zip(sorted(langs[k]), trees[k][1], strict=True):
            proof, cur = "", claimed
            for a, b in path + above:
                proof, cur = proof + a + b, digest(a, cur, b)
            out.append((key[1] if key[0] else None, own, trees[k][0], root, digest(proof), cur, cur == root))
    return sorted(out, key=str)


def proofs(docs):
    more = F.when(held_out(F.col("doc_id"), 7, 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return M.Manifest(docs, claimed={"n_chars": more})


def test_edge_rows_equal_plain_recursion(spark, edge_docs):
    got = sorted(map(tuple, proofs(edge_docs).proofs().collect()), key=str)
    assert got == plain(edge_docs.collect())


def test_several_bands_and_nested_intervals(spark):
    lang = F.when(F.col("id") < 2300, "en").when(F.col("id") < 3324, "de").when(F.col("id") == 3324, "x")
    docs = spark.range(3400).select(
        F.col("id").alias("doc_id"), lang.alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"),
        F.concat(F.lit("text "), F.col("id") % 50).alias("text"),
    )
    made = proofs(docs)
    assert sorted(map(tuple, made.proofs().collect()), key=str) == plain(docs.collect())
    nodes = made.nodes().where("tree = '2:en'").collect()
    assert sorted(r.lo for r in nodes if r.level == 0) == list(range(2300))
    by_level = {k: sorted((r.lo, r.hi) for r in nodes if r.level == k) for k in {r.level for r in nodes}}
    assert by_level[max(by_level)] == [(0, 2300)]
    for k, spans in by_level.items():
        assert [a for a, _ in spans] == list(range(0, 2300, 1 << k)) and spans[-1][1] == 2300


def test_untouched_rows_verify_and_changed_ones_do_not(spark, edge_docs):
    assert {r.verified for r in M.Manifest(edge_docs).proofs().collect()} == {True}
    changed = M.Manifest(edge_docs, claimed={"text": F.lit("another text")}).proofs().collect()
    assert {r.verified for r in changed} == {False}


def test_empty_table(spark, no_docs):
    made = proofs(no_docs)
    assert made.proofs().count() == 0 and made.nodes().count() == 0
