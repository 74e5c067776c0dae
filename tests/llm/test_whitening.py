"""Whitening against numpy over all rows, copies and odd rows included."""

import math
from fractions import Fraction

import numpy as np
import pytest

from iotlens.llm import whitening


def vectors(seed, n=300, d=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    rows = [(k, [float(v) for v in base[k]]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 2)]  # a third of all rows
    return rows + [(2 * n + k, rows[k % 5][1]) for k in range(20)]


def brute(rows, d):
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in kept], float)
    c = x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / len(x))
    order = np.argsort(-e)[:8]
    n, total = len(kept), [sum(v[k] for _, v in kept) for k in range(d)]
    deviation = [sum((n * v[k] - total[k]) ** 2 for k in range(d)) for _, v in kept]
    return [i for i, _ in kept], deviation, c @ u[:, order] / np.sqrt(e[order]), e[order] / e.sum()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_rows(spark, seed):
    rows = vectors(seed)
    odd = [(9001, None), (9002, []), (9003, [1.0, None] + [0.0] * 10), (9004, [float("nan")] + [0.0] * 11), (9005, [float("inf")] + [0.0] * 11), (9006, [1.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<double>, n int, x double").repartition(4)
    out = whitening.whiten(df).collect()
    ids, deviation, z, share = brute(rows + odd, 12)
    assert len(out) == 8 * len(ids) and {r["n"] for r in out} == {len(ids)}
    by = {(r["vec_id"], r["component"]): r for r in out}
    sign = [math.copysign(1, by[ids[0], k + 1]["whitened"] * z[0, k]) for k in range(8)]
    for j, i in enumerate(ids):
        for k in range(8):
            r = by[i, k + 1]
            assert r["deviation"] == deviation[j]
            assert abs(r["whitened"] - sign[k] * z[j, k]) < 1e-7
            assert abs(r["explained"] - share[k]) <= 1e-9
            assert 0 <= r["identity_error"] < 1e-9


def test_null_and_repeated_ids(spark):
    rows = [(None, [1.0, 2.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [5.0, -3.0]), (1, [4.0, 4.0])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(out) == 10 and sum(r["vec_id"] is None for r in out) == 2 and {r["component"] for r in out} == {1, 2}


def test_no_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in flat)
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []


def test_unweighted_fit(spark):
    rows = [(k, [float(k % 3), float(k * k % 5)]) for k in range(30)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), fit_weights=False).collect()
    assert {r["n"] for r in out} == {len({tuple(v) for _, v in rows})}


def test_deviation_beyond_64_bits_raises(spark):
    rows = [(1, [1e8]), (2, [-1e8])] * 200
    with pytest.raises(Exception, match="beyond 64 bits"):
        whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()


def test_centred_integers_are_exact():
    x = np.array([[1 << 40, 5]])
    assert whitening._centred(x, 1 << 30, [3, 4])[0, 0] == Fraction(1 << 70) - 3
