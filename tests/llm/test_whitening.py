"""Eigenpairs against a dense solver, and whitening against plain arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pytest

from storegrain.llm import whitening
from storegrain.llm.jacobi_davidson import largest_eigenpairs, minres, orthonormal

RANDOM = np.random.default_rng(11)


def matrices():
    a = RANDOM.standard_normal((70, 70))
    yield "random", a @ a.T
    yield "close", np.diag(1000 + np.arange(120) * 0.01)
    yield "spike", np.diag(np.r_[1e8, np.linspace(1, 2, 90)])
    q = np.linalg.qr(RANDOM.standard_normal((60, 60)))[0]
    yield "indefinite", q @ np.diag(np.linspace(-50, 40, 60)) @ q.T
    yield "small", a[:5] @ a[:5].T
    yield "one", np.array([[3.0]])


@pytest.mark.parametrize(("name", "matrix"), list(matrices()))
def test_pairs_are_those_of_a_dense_solver(name, matrix):
    products = []

    def product(block):
        products.append(block.shape[1])
        return matrix @ block

    values, vectors = largest_eigenpairs(product, len(matrix), 8)
    wanted = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    scale = np.abs(np.linalg.eigvalsh(matrix)).max()
    assert len(values) == min(8, len(matrix))
    assert np.abs(values - wanted).max() <= 1e-13 * scale
    assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert (vectors[np.abs(vectors).argmax(axis=0), range(len(values))] > 0).all()
    assert len(products) < 400


def test_repeated_and_missing_variance():
    for matrix in (np.zeros((40, 40)), np.eye(40), np.diag(np.r_[np.full(3, 7.0), np.zeros(60)])):
        values, vectors = largest_eigenpairs(lambda block, m=matrix: m @ block, len(matrix), 8)
        assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:8], atol=1e-13)
        assert np.allclose(vectors.T @ vectors, np.eye(8), atol=1e-13)


def test_minres_solves_shifted_systems():
    a = RANDOM.standard_normal((30, 30))
    a = a + a.T
    shifts, right = np.array([0.3, -40.0, 2.0]), RANDOM.standard_normal((30, 3))
    right[:, 2] = 0
    got = minres(lambda b: a @ b, shifts, lambda b, _: b, right, 200, 1e-12)
    for k in range(3):
        assert np.allclose((a - shifts[k] * np.eye(30)) @ got[:, k], right[:, k], atol=1e-6)


def test_dependent_columns_fall_away():
    block = RANDOM.standard_normal((9, 3))
    made = orthonormal(np.column_stack([block, block @ np.ones(3), np.zeros(9)]), np.eye(9)[:, :2])
    assert made.shape == (9, 3)
    assert np.allclose(np.column_stack([np.eye(9)[:, :2], made]).T @ np.column_stack([np.eye(9)[:, :2], made]), np.eye(5))


def plain(rows, dim, count):
    """Expected values by vector id, in Python's whole numbers and a dense solver."""
    good = [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return [
        (i, n, sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)), c @ vectors / np.sqrt(values))
        for (i, _), row, c in zip(good, x, centred, strict=True)
    ], values / np.trace(covariance)


def vector_rows(n=300, dim=40):
    chosen = np.random.default_rng(5)
    made = [(k, (chosen.standard_normal(dim) * np.linspace(0.1, 1, dim)).astype(np.float32).tolist()) for k in range(n)]
    made += [(7, made[8][1]), (None, made[9][1]), (11, made[11][1])] + [(1000 + k, made[20][1]) for k in range(n // 2)]
    made += [(2000, None), (2001, []), (2002, [0.5] * 3), (2003, [0.1] * (dim - 1) + [None]), (2004, [float("nan")] * dim),
             (2005, [float("inf")] + [0.0] * (dim - 1))]
    return made


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "clash") for i, v in rows], "vec_id long, embedding array<float>, component int, whitened string").repartition(5)


@pytest.mark.parametrize("dim", [40, 5])
def test_whitened_vectors(spark, dim):
    rows = vector_rows(dim=dim)
    count = min(8, dim)
    wanted, shares = plain(rows, dim, count)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == len(wanted) * count
    signs = {}
    by_key = {}
    for r in got:
        by_key.setdefault((str(r.vec_id), int(r.deviation)), {})[r.component] = r
    for i, n, deviation, whitened in wanted:
        own = by_key[str(i), deviation]
        for c in range(1, count + 1):
            r = own[c]
            sign = signs.setdefault(c, 1 if r.whitened * whitened[c - 1] > 0 else -1)
            assert abs(r.whitened - sign * whitened[c - 1]) < 1e-9
            assert r.n == n and abs(r.explained / shares[c - 1] - 1) < 1e-12 and r.identity_error < 1e-12


def test_vectors_without_variance(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5] * 12)] * 3)).collect()
    assert len(got) == 24 and {r.whitened for r in got} == {None} and {r.explained for r in got} == {None}
    line = [(k, [float(k)] * 12) for k in range(5)]
    got = whitening.whiten(frame(spark, line)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1}
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 for r in got)


def test_empty_tables_and_large_numbers(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    rows = [(k, [k * 1e11, -k * 3e11]) for k in range(4)]
    big = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(big).collect()}
    assert got == {k: sum((4 * a - s) ** 2 for a, s in zip(x[k], sums, strict=True)) for k in range(4)}
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>"))
