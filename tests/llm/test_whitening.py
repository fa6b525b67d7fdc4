"""Operator 13 against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from tallyspark.llm import queries, whitening as W
from tallyspark.sources.tables import read_table


def table(spark, rows, extra=()):
    schema = "vec_id long, embedding array<float>" + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *("x" for _ in extra))
                                  for i, v in rows], schema)


def check(rows, out, components=8):
    """rows: the vectors that remain."""
    x = np.floor(1024 * np.array([np.float32(v) for _, v in rows], np.float64)).astype(np.int64) + 100000
    n, S = len(x), x.sum(0)
    dev = n * x - S
    cov = (dev / n).T @ (dev / n) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-9 * max(values[0], 1e-300)).sum())
    k = min(components, rank)
    got = {}
    for r in out:
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == ({i for i, _ in rows} if k else set())
    for j in range(1, k + 1):
        ours = np.array([got[i][j].whitened for i, _ in rows])
        alone = (j < 2 or values[j - 2] / values[j - 1] > 1 + 1e-4) and (j == rank or j == len(values) or values[j - 1] / values[j] > 1 + 1e-4)
        if alone:
            theirs = (x - S / n) @ vectors[:, j - 1] / math.sqrt(values[j - 1])
            theirs *= np.sign(theirs @ ours)
            assert np.allclose(ours, theirs, atol=1e-6, rtol=1e-6)
        assert abs(ours.mean()) < 1e-9 and abs((ours ** 2).mean() - 1) < 1e-9
        for (i, _), square in zip(rows, (dev.astype(object) ** 2).sum(1)):
            r = got[i][j]
            assert (r.n, int(r.deviation)) == (n, int(square))
            assert math.isclose(r.explained, values[j - 1] / values.sum(), rel_tol=1e-6)
            assert r.identity_error < 1e-8
    assert all(len(c) == k for c in got.values())


def test_against_eigh(spark):
    rng = np.random.default_rng(1)
    for n, d in ((200, 12), (40, 3), (5, 9)):
        mix = rng.normal(size=(d, d))
        rows = [(k, v) for k, v in enumerate(rng.normal(size=(n, d)) @ mix + rng.normal(size=d))]
        check(rows, W.whiten(table(spark, rows)).collect())


def test_repeated_eigenvalues_and_lost_rank(spark):
    d = 6
    square = [(k, [(3 if k % 2 else -3) * (j == k // 2) for j in range(d)]) for k in range(2 * d)]  # all eigenvalues alike
    check(square, W.whiten(table(spark, square)).collect())
    twice = [(k, [v[0], v[0], v[1], 0.5, v[1] - v[0], 2.0]) for k, v in square]  # four of six dimensions add nothing
    check(twice, W.whiten(table(spark, twice)).collect())
    same = [(k, [1.0, 2.0]) for k in range(5)]
    assert W.whiten(table(spark, same)).count() == 0


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=4)) for k in range(20)]
    bad = [(90, None), (91, []), (92, [1, None, 2, 3]), (93, [1, float("nan"), 2, 3]), (94, [1, float("inf"), 2, 3]),
           (95, [1, 2, 3]), (96, [1e30, 0, 0, 0])]
    out = W.whiten(table(spark, good + bad, extra=["vector", "component", "n"])).collect()
    check(good, out)
    assert W.whiten(table(spark, [])).count() == 0 and W.whiten(table(spark, bad[:5])).count() == 0
    assert W.whiten(table(spark, good[:1])).count() == 0
    repeated = W.whiten(table(spark, [*good, good[0], (None, good[1][1])])).collect()
    assert len(repeated) == 22 * 4 and {r.n for r in repeated} == {22}
    large = [(k, v * 1e6) for k, v in good]
    out = W.whiten(table(spark, large)).collect()
    check(large, out)


def test_polynomial_roots_and_primes(spark):
    rng = np.random.default_rng(3)
    b = rng.integers(-50, 50, (7, 7)).astype(object)
    a = b.dot(b.T)
    q = W.characteristic_polynomial(spark, a)
    assert q[0] == 1 and q[1] == -sum(a[k, k] for k in range(7))
    for x in range(-3, 5):  # equals the determinant, by fractions
        from fractions import Fraction
        m = [[Fraction(int((x if i == j else 0) - a[i, j])) for j in range(7)] for i in range(7)]
        det = Fraction(1)
        for c in range(7):
            p = next((r for r in range(c, 7) if m[r][c]), None)
            if p is None:
                det = Fraction(0)
                break
            if p != c:
                m[c], m[p], det = m[p], m[c], -det
            det *= m[c][c]
            for r in range(c + 1, 7):
                f = m[r][c] / m[c][c]
                m[r] = [u - f * w for u, w in zip(m[r], m[c])]
        assert det == sum(c * x ** (7 - k) for k, c in enumerate(q))
    roots, s = W.largest_roots(q, 8)
    assert np.allclose([z / 2 ** s for z in roots], np.linalg.eigvalsh(a.astype(float))[::-1][:len(roots)], rtol=1e-9, atol=1e-6)
    # (x - 2)^3 (x - 5)^2 x
    q = np.poly([2, 2, 2, 5, 5, 0]).round().astype(int).tolist()
    roots, s = W.largest_roots(q, 8)
    assert [z / 2 ** s for z in roots] == pytest.approx([5, 5, 2, 2, 2])
    assert [p for p in range(60) if W._is_prime(p)] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    assert W.primes_above(1)[0] == 2147483647


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, sf, "embeddings").collect()]
    out = queries.QUERIES["op13_whitening"](spark, sf)
    assert dict(out.dtypes)["deviation"] == "bigint"
    check(rows, out.collect())
