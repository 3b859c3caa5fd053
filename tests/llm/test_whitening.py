"""Whitening against numpy's eigenvectors of the centred covariance."""

import math
import random

import numpy as np
import pytest

from wayfold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component int"


def plain(rows, count=4):
    """vec_id -> (deviation, whitened up to sign), and n, explained."""
    keep = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in keep]
    fit = sorted(set(x for _, x in xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    live = values > 1e-18 * values[0]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array(x, float) - np.array(sums) / n) @ vectors[:, live] / np.sqrt(values[live])) for i, x in xs]
    return n, out, values[live] / np.trace(centred.T @ centred / n)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", 3) for i, v in rows], SCHEMA).repartition(3)


def held(spark, rows):
    got = {}
    for r in whitening.whiten(frame(spark, rows)).collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    return got


ODD = [(901, None), (902, []), (903, [float("nan")] * 6), (904, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (905, [float("inf")] * 6), (906, [1.0] * 5)]


@pytest.mark.parametrize("steps", [64, 5])
def test_equals_eigenvectors(spark, monkeypatch, steps):
    monkeypatch.setattr(whitening, "STEPS", steps)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 6)) * [3, 2.5, 1, .5, .2, .01] @ np.linalg.qr(rng.standard_normal((6, 6)))[0] + 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[7].tolist()) for i in range(400, 600)] + [(None, x[8].tolist()), (1, x[9].tolist())] + ODD
    n, want, explained = plain([r for r in rows if r[0] != 906])
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"]), {})[r["component"]] = r
    signs = None
    for i, deviation, y in want:
        rows_ = by[(i if i is not None else -1, deviation)]
        mine = np.array([rows_[c]["whitened"] for c in (1, 2, 3, 4)])
        signs = np.sign(mine * y) if signs is None else signs
        assert np.allclose(mine, y * signs, rtol=1e-9, atol=1e-9)
    assert all(abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-10 and r["identity_error"] < 1e-9 for r in got)


def test_few_vectors_have_fewer_components(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert sorted({r["component"] for r in got}) == [1, 2] and {r["n"] for r in got} == {3}  # equal variances are both found
    assert all(abs(r["explained"] - 0.5) < 1e-12 and r["identity_error"] < 1e-12 for r in got)
    for rows in ([(1, [1.0, 2.0])] * 3, ODD[:5], []):
        assert whitening.whiten(frame(spark, rows)).collect() == []


def test_large_numbers_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1) * 1e5)) for _ in range(3)]) for i in range(40)]
    n, want, _ = plain(rows)
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    assert got == {i: d for i, d, _ in want}
    far = [(i, [float(i) * 1e12, 1.0]) for i in range(5)]
    assert {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, far)).collect()}[4] is None


def test_steps_stop_at_convergence():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 120)) * np.concatenate(([40, 30, 20, 10], np.full(116, .3))) @ np.linalg.qr(rng.standard_normal((120, 120)))[0]
    x -= x.mean(0)
    asked = []

    def multiply(t):
        asked.append(1)
        p = x @ t
        return x.T @ p, p @ p

    values, vectors = whitening.bidiagonal(multiply, 120, 4)
    _, s, v = np.linalg.svd(x)
    assert len(asked) < 120 and np.allclose(values, s[:4], rtol=1e-12) and np.allclose(np.abs(np.sum(v[:4].T * vectors, 0)), 1, atol=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
