import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component int"


def frame(spark, vectors, parts=3):
    rows = [(i, v, "x", 1) for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors):
    """From the contract, with fractions up to the covariance."""
    sound = [(i, v) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in sound]
    fit = sorted({x for _, x in xs})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for x in fit]
    cov = [[sum(c[i] * c[j] for c in centred) / n for j in range(dims)] for i in range(dims)]
    deviation = {(i, x): sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in xs}
    return xs, n, sums, np.array([[float(v) for v in row] for row in cov]), deviation


def vectors(seed, count, dims):
    rng = random.Random(seed)
    made = [(i, [rng.gauss(0, 1 + 3 * d) + 0.5 * d for d in range(dims)]) for i in range(count)]
    return made + [
        (900, made[3][1]),  # a repeated vector
        (3, made[3][1]),  # a repeated row
        (None, made[4][1]),
        (901, None),
        (902, []),
        (903, [None, *made[0][1][1:]]),
        (904, [math.nan, *made[0][1][1:]]),
        (905, [math.inf, *made[0][1][1:]]),
    ]


@pytest.mark.parametrize("count, dims", [(60, 5), (200, 20), (12, 20)])
def test_against_brute_force(spark, count, dims):
    rows = vectors(count, count, dims)
    xs, n, sums, cov, deviation = brute(rows)
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    got = whitening.whitened(frame(spark, rows)).collect()
    k = min(16, dims, n - 1)
    assert len(got) == k * len(xs)
    assert {r["component"] for r in got} == set(range(1, k + 1))
    signs, by_id = {}, {}
    for i, x in xs:
        by_id.setdefault(i, []).append(x)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for r in got:
        c, x = r["component"] - 1, by_id[r["vec_id"]][0]
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"], x]
        assert math.isclose(r["explained"], values[c] / np.trace(cov), rel_tol=1e-9)
        want = (np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ basis[:, c]) / math.sqrt(values[c])
        if abs(want) > 1e-3:
            signs.setdefault(c, math.copysign(1, want * r["whitened"]))
        assert math.isclose(r["whitened"], signs.get(c, 1) * want, rel_tol=1e-6, abs_tol=1e-6) or abs(want) <= 1e-3


def _orthogonal(size, seed):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


@pytest.mark.parametrize(
    "values",
    [
        [9.0, 4, 2, 1, 0.5],
        [5.0, 5 - 1e-5, 5 - 2e-5, 1, 1 - 1e-6, 1e-3],  # nearer than float32 tells apart
        [5.0, 5 - 1e-9, 5 - 2e-9, 3, 3 - 1e-12, 1],
        [2.0, 2, 2, 1, 1, 0, 0],
        [1e8, 1, 1e-4, 1e-5, 2e-6, 1e-6],
        list(np.linspace(1, 2, 64)),
    ],
)
def test_refinement_reaches_double_precision(values):
    """Beyond what eigenvectors in double reach: residuals against the gaps of their values."""
    size = len(values)
    q = _orthogonal(size, size).astype(np.longdouble)
    for _ in range(4):  # orthogonal in extended precision
        q = q + q @ (np.eye(size, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.refined(a)
    norm = np.abs(a).max()
    assert np.abs(x.T @ x - np.eye(size)).max() < 1e-17
    assert np.abs(a @ x - x * found).max() < 1e-16 * norm
    order = np.argsort(values)[::-1]
    assert np.allclose(found.astype(float), np.array(values)[order], rtol=1e-9, atol=1e-16 * float(norm))
    for k, place in enumerate(order):
        gap = min((abs(values[place] - v) for i, v in enumerate(values) if i != place), default=1)
        if gap > 1e-8 * max(values):
            assert abs(abs(float(x[:, k] @ q[:, place])) - 1) < 1e-13
            assert np.abs(x[:, k] * np.sign(x[:, k] @ q[:, place]) - q[:, place]).max() < 1e-16 * norm / gap


def test_the_float32_start_alone_is_not_enough():
    q, values = _orthogonal(40, 1), np.linspace(1, 1.001, 40)
    a = (q * values) @ q.T
    start = np.linalg.eigh(a.astype(np.float32))[1]
    found, x = whitening.refined(a)
    assert np.abs(a @ start - start * values).max() > 1e-8
    assert np.abs(a.astype(np.longdouble) @ x - x * found).max() < 1e-16


def test_equal_vectors_other_lengths_and_empty_tables(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert whitening.whitened(frame(spark, same)).count() == 0  # no variance
    mixed = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)] + [(50, [1.0])]
    got = whitening.whitened(frame(spark, mixed)).collect()
    assert {r["vec_id"] for r in got} == set(range(9)) and {r["component"] for r in got} == {1, 2}
    nothing = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert nothing.count() == 0 and nothing.columns[:3] == ["vec_id", "component", "n"]


def test_deviation_beyond_a_long():
    model = whitening.Whitening(2, [0, 0], np.eye(2), np.ones(2), np.ones(2))
    assert model.deviations(np.array([[1, 2], [3, 0]])) == [20, 36]
    assert model.deviations(np.array([[1, 2], [1 << 40, 0], [1 << 30, 1]])) == [20, None, (1 << 62) + 4]
