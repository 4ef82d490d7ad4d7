"""Whitening, exact search and vector codes against plain versions, and on odd tables."""

import hashlib
import random

import numpy as np
import pytest

from swathe.llm import balltree, codes, queries, whitening
from swathe.llm.common import table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, vector string, code string, rank int, query_id long"


def rows_of(spark, pairs, labels=None):
    return spark.createDataFrame(
        [(i, v, labels[n] if labels else n % 3, "x", "y", 1, 2) for n, (i, v) in enumerate(pairs)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    pairs = [(i, [rng.uniform(-1, 1) for _ in range(16)]) for i in range(0, 260, 5)]
    pairs += [(200, pairs[40][1]), (200, pairs[40][1]), (100, pairs[3][1]), (None, pairs[20][1]), (None, pairs[20][1])]
    bad = [(7, None), (300, []), (9, [None] * 16), (400, [1.0] * 15 + [float("nan")]), (11, [float("inf")] * 16),
           (500, [0.5] * 12), (600, [1e30] * 16)]
    return rows_of(spark, pairs + bad, [None if n % 4 == 0 else n % 3 for n in range(len(pairs) + len(bad))]), pairs


# -- operator 11 -------------------------------------------------------------------------

def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, "float32").astype("float64")).astype("int64") + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = (n * x - sums) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, y, values[::-1], axes[:, ::-1].T, np.trace(y.T @ y / n)


def check_whitening(got, pairs, vectors):
    x, n, sums, y, values, axes, total = plain_whitening(vectors)
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, min(8, x.shape[1]) + 1))
    for k, rows in by_component.items():
        assert len(rows) == n and {r["n"] for r in rows} == {n}
        assert all(r["explained"] == pytest.approx(values[k - 1] / total, rel=1e-9) for r in rows)
        key = lambda p: (p[0] is None, p[0] or 0, p[1])
        own = sorted(zip([p[0] for p in pairs], (y @ axes[k - 1] / np.sqrt(values[k - 1])).tolist()), key=key)
        mine = sorted(((r["vec_id"], r["whitened"]) for r in rows), key=key)
        flipped = sorted(((r["vec_id"], -r["whitened"]) for r in rows), key=key)
        close = [np.allclose([m[1] for m in side], [o[1] for o in own], atol=1e-7) for side in (mine, flipped)]
        assert any(close)
        deviation = {(i, int(d)) for (i, _), d in zip(pairs, ((n * x - sums) ** 2).sum(axis=1))}
        assert {(r["vec_id"], r["deviation"]) for r in rows} == deviation
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening(spark, odd):
    pairs = [(r["vec_id"], r["embedding"]) for r in table(spark, FOLDER, "embeddings").collect()]
    check_whitening(queries.op11_embedding_whitening(spark, FOLDER).collect(), pairs, [p[1] for p in pairs])
    check_whitening(whitening.whiten(odd[0]).collect(), odd[1], [p[1] for p in odd[1]])
    assert whitening.whiten(odd[0].limit(0)).count() == 0


def test_whitening_without_variance(spark):
    flat = whitening.whiten(rows_of(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in flat] == [(None, 0.0, 0)] * 4
    line = whitening.whiten(rows_of(spark, [(1, [0.5, 0.25]), (2, [-0.5, 0.25])])).collect()
    assert sorted((r["component"], abs(r["whitened"]) if r["whitened"] is not None else None, r["explained"])
                  for r in line if r["vec_id"] == 1) == [(1, pytest.approx(1.0), pytest.approx(1.0)), (2, None, 0.0)]
    assert whitening._deviations(np.array([[1 << 30, 1], [1 << 32, 0]])) == [(1 << 60) + 1, None]


@pytest.mark.parametrize("values", [
    [9, 5, 5, 5, 2, 1, 1, 0.5, 0.1, 0], [1] * 12, [3, 3 - 1e-13, 2, 1e-9, 1e-9, 0, 0, 0], [4, 1], [2], [0, 0, 0]])
def test_leading_components(values):
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    matrix = basis @ np.diag(values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    for symmetric in (matrix, np.diag(np.array(values, "float64"))):
        found, vectors = whitening.leading_components(symmetric, 8)
        k = min(8, len(values))
        assert np.allclose(found, sorted(values, reverse=True)[:k], atol=1e-13 * max(values[0], 1) * len(values))
        assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
        assert np.allclose(symmetric @ vectors.T, vectors.T * found, atol=1e-12 * max(values[0], 1))


def test_sturm_counts():
    rng = np.random.default_rng(6)
    matrix = rng.standard_normal((30, 30))
    matrix += matrix.T
    diagonal, off, _ = whitening.tridiagonal(matrix)
    exact = np.linalg.eigvalsh(matrix)
    at = np.linspace(exact[0] - 1, exact[-1] + 1, 200)
    assert (whitening.sturm_counts(diagonal, off, at) == (exact[None, :] < at[:, None]).sum(axis=1)).all()


# -- operator 12 -------------------------------------------------------------------------

def plain_top(pairs, every, k):
    whole = [(i, np.floor(1024 * np.array(v, "float32").astype("float64")).astype("int64")) for i, v in pairs]
    out = []
    for n, (i, v) in enumerate(whole):
        if i is not None and i % every == 0:
            scored = sorted(((-int(v @ w), j is None, j or 0) for m, (j, w) in enumerate(whole) if m != n))[:k]
            out += [(i, rank, None if null else j, -s) for rank, (s, null, j) in enumerate(scored, 1)]
    return sorted(out, key=str)


def test_exact_top_k(spark, odd):
    found = sorted(map(tuple, balltree.top_k(odd[0], 100, 10).collect()), key=str)
    assert found == plain_top(odd[1], 100, 10)
    few = odd[1][:3]
    assert sorted(map(tuple, balltree.top_k(rows_of(spark, few), 5, 10).collect()), key=str) == plain_top(few, 5, 10)
    assert balltree.top_k(odd[0].limit(0), 100, 10).count() == 0
    assert balltree.top_k(odd[0].where("vec_id = 100").limit(1), 100, 10).count() == 0


def test_blocks_of_queries_and_shards_change_nothing(spark, odd, monkeypatch):
    monkeypatch.setattr(balltree, "LEAF", 3)
    found = balltree.top_k(odd[0].repartition(3), 5, 4, block=7)
    assert sorted(map(tuple, found.collect()), key=str) == plain_top(odd[1], 5, 4)


def test_tree_prunes_and_loses_nothing():
    rng = np.random.default_rng(7)
    heart = rng.integers(-900, 900, (40, 16))
    points = (heart[rng.integers(0, 40, 5000)] + rng.integers(-30, 30, (5000, 16))).astype("int32")
    asked = points[::250]
    tree, order = balltree.BallTree.build(points)
    ids = np.arange(5000)[order]
    best = balltree.Best(np.full(len(asked), -np.inf), 5)
    visited = balltree.search(tree, ids, np.zeros(5000, bool), asked, best)
    assert visited < 0.2 * len(asked) * (tree.child < 0).sum()
    for q, row in enumerate(asked):
        want = sorted((-int(row.astype("int64") @ p), i) for i, p in enumerate(points.astype("int64")))[:5]
        assert [(-s, i) for s, i in zip(best.score[best.q == q], best.id[best.q == q])] == want
    # With the k-th score known from elsewhere fewer leaves are opened.
    again = balltree.Best(best.floor, 5)
    assert balltree.search(tree, ids, np.zeros(5000, bool), asked, again) <= visited


def test_large_products_are_exact():
    a, b = np.array([[2 ** 22, 2 ** 22 - 1] * 8]), np.array([[2 ** 22 - 1, 2 ** 22] * 8])
    assert balltree.products(a, b)[0, 0] == 16 * 2 ** 22 * (2 ** 22 - 1)


# -- operator 13 -------------------------------------------------------------------------

def plain_codes(pairs, labels):
    whole = [[int(np.floor(4096 * float(np.float32(x)))) for x in v] for _, v in pairs]
    size = len(whole[0]) // 8
    cut = [[tuple(v[p * size:(p + 1) * size]) for p in range(8)] for v in whole]
    ranked = sorted(range(len(pairs)), key=lambda n: (pairs[n][0] is None, pairs[n][0] or 0, whole[n]))[:16]
    books = [[cut[n][p] for n in ranked] for p in range(8)]
    nearest = lambda p, part: min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(books[p]))
    for _ in range(6):
        held = {}
        for row in cut:
            for p, part in enumerate(row):
                held.setdefault((p, nearest(p, part)[1]), []).append(part)
        for (p, i), own in held.items():
            books[p][i] = tuple(sum(c) // len(own) for c in zip(*own))
    final = [[nearest(p, part) for p, part in enumerate(row)] for row in cut]
    errors = [sum(d for d, _ in row) for row in final]
    total = {}
    for label, error in zip(labels, errors):
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in row), error, total[label], digest)
                   for (i, _), row, error, label in zip(pairs, final, errors, labels)), key=str)


def test_vector_codes(spark, odd):
    labels = [None if n % 4 == 0 else n % 3 for n in range(len(odd[1]))]
    got = sorted(map(tuple, codes.compress(odd[0]).collect()), key=str)
    assert got == plain_codes(odd[1], labels)
    few = odd[1][:5]
    got = sorted(map(tuple, codes.compress(rows_of(spark, few, [1, None, 1, None, 2])).collect()), key=str)
    assert got == plain_codes(few, [1, None, 1, None, 2])
    assert codes.compress(odd[0].limit(0)).count() == 0
    assert codes.compress(rows_of(spark, [(1, [0.5] * 3)])).first()["error"] == 0


def test_equal_average_search():
    rng = np.random.default_rng(8)
    entries, parts = rng.integers(-50, 50, (16, 4)), rng.integers(-60, 60, (3000, 4))
    entries[5] = entries[2]
    entry, least, computed = codes.Codebook(entries).nearest(parts)
    distance = ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (entry == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
    assert computed < 0.9 * distance.size
