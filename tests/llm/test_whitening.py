from fractions import Fraction

import numpy as np
import pytest

from qualityframe.llm import whitening


def symmetric(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return q @ np.diag(values) @ q.T


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 64])
def test_counts_and_eigenpairs(size):
    rng = np.random.default_rng(size)
    for values in (rng.random(size) * 100, 10.0 ** -np.arange(size).clip(0, 9), np.round(rng.random(size) * 3)):
        v = symmetric(rng, np.sort(values)[::-1])
        v = (v + v.T) / 2
        want = np.sort(np.linalg.eigvalsh(v))[::-1]
        for shift in rng.random(8) * want[0]:
            if np.abs(want - shift).min() > 1e-9:
                assert whitening.above(v, shift) == (want > shift).sum()
        got, vectors = whitening.leading(v, 16)
        k = min(size, 16)
        assert len(got) == k and np.allclose(got, want[:k], atol=1e-12 * max(1, want[0]) * size)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        assert np.abs(v @ vectors - vectors * got).max() < 1e-11 * max(1, want[0])


def test_close_and_zero_eigenvalues():
    rng = np.random.default_rng(1)
    v = symmetric(rng, np.array([5, 5, 5, 2, 1 + 1e-9, 1, 0, 0.0]))
    got, vectors = whitening.leading((v + v.T) / 2, 8)
    assert np.allclose(got, [5, 5, 5, 2, 1 + 1e-9, 1, 0, 0], atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert np.array_equal(whitening.leading(np.zeros((3, 3)), 2)[0], [0, 0])


def plain(rows, components=16):
    """{(row number, component): (n, deviation, whitened up to sign, explained)}"""
    xs = {i: tuple(int(np.floor(64 * c)) + 1_000_000 for c in r) for i, r in enumerate(rows)}
    fit = sorted(set(xs.values()))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(x - m) for x, m in zip(r, mean)] for r in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = {}
    for i, x in xs.items():
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        c = np.array([float(a - m) for a, m in zip(x, mean)])
        for k in range(min(components, len(values))):
            e = values[-1 - k]
            out[i, k + 1] = (n, deviation, c @ vectors[:, -1 - k] / np.sqrt(e), e / values.sum())
    return out


def check(got, want):
    by, parts = {}, {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    assert len(got) == len(want)
    for k, rows in by.items():
        ours = np.array([r.whitened for r in rows])
        theirs = np.array([want[r.vec_id, k][2] for r in rows])
        sign = np.sign(ours @ theirs)
        assert np.abs(ours * sign - theirs).max() < 1e-7
        assert all((r.n, r.deviation) == want[r.vec_id, k][:2] for r in rows)
        assert all(abs(r.explained / want[r.vec_id, k][3] - 1) < 1e-9 for r in rows)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whole_table(spark, sample):
    table = spark.read.parquet(f"{sample}/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    ids = sorted(rows)
    got = whitening.op12(table).collect()
    want = {(ids[i], k): v for (i, k), v in plain([rows[i] for i in ids]).items()}
    check(got, want)


def test_copies_count_once_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = (rng.standard_normal((40, 5)) * [9, 5, 3, 2, 1]).tolist()
    rows = base + [base[0]] * 60
    good = [(i, r, "x") for i, r in enumerate(rows)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0]), (902, [nan] * 5), (903, [inf] * 5), (904, []), (905, [1.0])]
    table = spark.createDataFrame(good + [(*r, "y") for r in odd], "vec_id long, embedding array<double>, key string")
    got = whitening.op12(table.repartition(5)).collect()
    assert got[0].n == 40
    check(got, plain(rows))
    unnamed = spark.createDataFrame([(None, r) for r in base], "vec_id long, embedding array<double>")
    assert len(whitening.op12(unnamed).collect()) == 40 * 5


def test_empty_flat_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.op12(spark.createDataFrame([], kind)).count() == 0
    one = whitening.op12(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], kind)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 4
    line = whitening.op12(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], kind)).collect()
    assert {r.component for r in line if r.whitened is None} == {2}
    assert all(abs(r.explained - 1) < 1e-12 for r in line if r.component == 1)
    huge = whitening.op12(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], kind)).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 4
