"""Spectral divide and conquer against LAPACK, and whitening against a direct computation."""

import math

import numpy as np
import pytest

from pulsegrid.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 33.0),
        np.concatenate([np.full(10, 5.0), np.full(10, 2.0), [9.0]]),
        np.full(12, 3.0),
        np.concatenate([10.0 ** -np.arange(14.0), np.zeros(4)]),
        np.concatenate([1.0 + 1e-12 * np.arange(6), [2.0, 1e-3]]),
        np.array([4.0]),
        np.array([1.0, -1.0, 0.0]),
    ],
)
def test_spectrum_equals_lapack(values):
    rng = np.random.default_rng(7)
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, vectors = whitening.spectrum(a)
    scale = np.abs(values).max()
    assert np.allclose(got, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), rtol=0, atol=1e-13)
    assert np.abs(a @ vectors - vectors * got).max() <= 1e-12 * scale


def test_polar_factor_is_the_sign_of_the_spectrum():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(40, 40))
    a = a + a.T
    w, q = np.linalg.eigh(a)
    assert np.allclose(whitening.polar_factor(a), (q * np.sign(w)) @ q.T, atol=1e-12)


def direct(rows, components=16):
    """What whiten() has to give, computed on one list with exact integers and LAPACK."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
    y = np.array([centred(x) for x in fit])
    w, q = np.linalg.eigh(y.T @ y / n)
    w, q = w[::-1], q[:, ::-1]
    out = {}
    for i, x in good:
        for k in range(min(components, d)):
            out[i, k + 1] = (n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), centred(x) @ q[:, k] / math.sqrt(w[k]), w[k] / w.sum())
    return out


def test_whiten_equals_a_direct_computation(spark):
    rng = np.random.default_rng(9)
    mixed = rng.normal(size=(20, 20)) * 10.0 ** -np.arange(0, 2, 0.1)
    rows = [(i, (rng.normal(size=20) @ mixed).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1_000 + i, rows[0][1]) for i in range(300)]  # a hot vector is fitted once
    rows += [(2_000, None), (2_001, [1.0] * 19 + [None]), (2_002, [float("nan")] + [0.0] * 19), (2_003, [float("inf")] + [0.0] * 19), (2_004, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumnsRenamed({"label": "x"}).repartition(7)
    want, got = direct(rows), whitening.whiten(df).collect()
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, whitened, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        s = sign.setdefault(r["component"], math.copysign(1.0, whitened * r["whitened"])) if abs(whitened) > 0.01 else sign.get(r["component"])
        if s is not None:
            assert r["whitened"] == pytest.approx(s * whitened, abs=1e-9)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] <= 1e-9


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [1e9, 0.25])]
    got = {(r["vec_id"], r["deviation"]) for r in whitening.whiten(spark.createDataFrame([(i, v, 0) for i, v in rows if abs(v[0]) < 1e7] + [(4, [1e6, 3.0], 0), (5, [-1e6, 7.0], 0), (6, [1.5, 0.1], 0)], SCHEMA)).collect()}
    want = {(i, v[1]) for (i, _), v in direct([(4, [1e6, 3.0]), (5, [-1e6, 7.0]), (6, [1.5, 0.1])]).items()}
    assert got == want
    assert whitening._deviation(np.array([[1 << 40, 5]]), 1_000, [7, 11]) == [(1_000 * (1 << 40) - 7) ** 2 + (5_000 - 11) ** 2]


def test_tables_without_variance(spark):
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [3.0, 2.0], 0), (None, [3.0, 2.0], 0), (4, [1.0], 0)], SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"], round(abs(r["whitened"]), 9)) for r in got) == [(0, 1, 2, 1.0), (0, 1, 2, 1.0), (1, 1, 2, 1.0)]


def test_entries_beyond_a_long_raise(spark):
    with pytest.raises(Exception, match="not below"):
        whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], 0), (2, [1.0, 0.0], 0)], SCHEMA)).collect()
