"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from kiln.llm import itq_dedup as V

SCHEMA = "vec_id long, embedding array<float>, label int, size long, place long, keys string, part int"


def plain(rows, cosine=0.98):
    """vec_id -> (links, smallest id reachable), for unique ids."""

    def good(r):
        e = r[1]
        return r[0] is not None and r[2] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    ids = [r for r in rows if good(r)]
    links, parent = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key in {(r[2], len(r[1])) for r in ids}:
        own = [r for r in ids if (r[2], len(r[1])) == key]
        x = np.array([r[1] for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(np.triu(x @ x.T >= cosine, 1)):
            links[own[a][0]] += 1
            links[own[b][0]] += 1
            u, v = sorted((top(own[a][0]), top(own[b][0])))
            parent[v] = u
    return {r[0]: (links[r[0]], top(r[0])) for r in rows}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", 3) for r in rows], SCHEMA)


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_clusters_copies_and_a_bucket_larger_than_a_block(spark):
    rng = np.random.default_rng(3)
    f32 = lambda x: [float(v) for v in np.asarray(x, np.float32)]
    rows = [(i, f32(rng.standard_normal(32)), i % 3) for i in range(600)]
    for c in range(40):  # chains and clusters around the threshold
        centre = rng.standard_normal(32)
        rows += [(1000 + 20 * c + k, f32(centre + rng.standard_normal(32) * 0.14), c % 3) for k in range(10)]
    centre = rng.standard_normal(32)
    rows += [(5000 + k, f32(centre + rng.standard_normal(32) * 0.01), 1) for k in range(1400)]
    rows += [(9000 + k, f32(centre), 1) for k in range(30)] + [(9100 + k, f32(centre * 3), 2) for k in range(5)]
    want = plain(rows)
    got = result(V.near_vectors(frame(spark, rows)))
    assert len(got) == len(rows)
    assert max(n for n, _ in want.values()) >= 1400 and sum(n > 0 for n, _ in want.values()) > 1600
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found <= there and found >= 0.9999 * there
    assert sum(got[k] == want[k] for k in want) >= 0.998 * len(want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 0.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.1], 1), (13, [-1.0, 0.0], 1),
        (14, [1e-30, 0.0], 1), (15, [1e30, 0.0], 1), (None, [1.0, 0.0], 1),
    ]
    got = result(V.near_vectors(frame(spark, rows)))
    group = {1, 2, 12, 14, 15}
    assert {k: v for k, v in got.items() if k in group} == {k: (4, 1) for k in group}
    assert got[None] == (0, None)
    assert all(got[k] == (0, k) for k in got if k not in group and k is not None)


def test_repeated_ids_and_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_vectors(frame(spark, rows)).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (3, 1, 1, False)]


def test_empty_table(spark):
    assert V.near_vectors(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("bits", [8, 16])
def test_codes_are_balanced_and_near_vectors_share_a_table(bits):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((2000, 48)) @ np.diag(np.linspace(0.2, 3, 48)) + 0.3
    codes = V.fit_codes(x, 48, bits, 0.98)
    ones = ((V.unit(x) - codes.mean) @ codes.planes > 0).mean(axis=0)
    assert ones.min() > 0.3 and ones.max() < 0.7
    u = V.unit(x)
    aside = rng.standard_normal(u.shape)
    aside = V.unit(aside - (aside * u).sum(axis=1, keepdims=True) * u)
    moved = 0.98 * u + math.sqrt(1 - 0.98**2) * aside
    assert (codes.keys(x) == codes.keys(moved)).any(axis=1).mean() > 0.999
