"""Whitening against numpy on all rows at once; odd vectors, ties, repeated rows, empty tables, extra columns."""

import numpy as np
import pytest

from linkforge.llm import whitening


def held(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<float>, component int, n int, x int, key string").repartition(3)


def by_row(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in out.items()}


def test_equals_numpy_at_once(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 6)) @ np.diag([3, 2, 1, 0.5, 0.2, 0.1]) + 40
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)]  # repeated vectors are fitted once
    rows += [(2000, None), (2001, [float("nan")] * 6), (2002, [None, *rows[0][1][1:]]), (2003, [float("-inf"), *rows[0][1][1:]]), (2004, [])]
    x = np.floor(256 * np.array([v for _, v in rows[:350]], float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    e, v = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    e, v = e[::-1], v[:, ::-1]
    got = by_row(whitening.whiten(held(spark, rows)))
    assert sorted(got) == sorted(i for i, _ in rows[:350])
    for (i, _), xi in zip(rows[:350], x):
        assert [g["component"] for g in got[i]] == [1, 2, 3, 4]
        for c, g in enumerate(got[i]):
            assert g["n"] == n and g["deviation"] == int(((n * xi - s) ** 2).sum())
            assert abs(g["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and g["identity_error"] < 1e-6
    for c in range(4):
        want = (x - s / n) @ v[:, c] / np.sqrt(e[c])
        have = np.array([got[i][c]["whitened"] for i, _ in rows[:350]])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-6


def test_chan_merge_equals_all_at_once():
    r = np.random.default_rng(2)
    x = r.integers(-(2**40), 2**40, (500, 5))
    parts = [whitening.moments(p) for p in np.array_split(x, 7)]
    while len(parts) > 1:
        parts.append(whitening.merged(parts.pop(0), parts.pop(0)))
    n, sums, mean, scatter = parts[0]
    assert n == 500 and sums == [int(c) for c in x.astype(object).sum(0)]
    assert np.allclose(mean, x.mean(0)) and np.allclose(scatter, np.cov(x.T.astype(float), bias=True) * 500)


def test_odd_populations(spark):
    assert whitening.whiten(held(spark, [])).count() == 0
    same = by_row(whitening.whiten(held(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [7.5])])))
    assert [(g["n"], g["whitened"], g["explained"], g["deviation"]) for g in same[1]] == [(1, None, None, 0)] * 2
    assert [len(same[i]) for i in (3, 4, 5)] == [1, 1, 1] and same[3][0]["n"] == 3
    assert abs(sum(same[i][0]["whitened"] for i in (3, 4, 5))) < 1e-9
    flat = by_row(whitening.whiten(held(spark, [(i, [float(i), 1.0]) for i in range(5)])))
    assert flat[0][1]["whitened"] is None and flat[0][0]["explained"] == pytest.approx(1) and flat[0][0]["identity_error"] < 1e-9
    wide = by_row(whitening.whiten(held(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])))
    assert wide[1][0]["deviation"] is None
