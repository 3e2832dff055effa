"""Density curves against a direct sum over all rows."""

from __future__ import annotations

import math

import numpy as np

from creditlens.operators import profile as prof


def _direct(xs, points):
    xs = np.array(xs)
    h = len(xs) ** -0.2 * xs.std(ddof=1)
    at = xs.min() - 0.5 * np.ptp(xs) + np.arange(points) * 2 * np.ptp(xs) / (points - 1)
    k = np.exp(-0.5 * ((at[:, None] - xs[None, :]) / h) ** 2).sum(axis=1)
    return k / (len(xs) * h * math.sqrt(2 * math.pi))


def test_series_nulls_repeats_and_constants(spark):
    rows = [(1.0, "a"), (2.0, "a"), (2.0, "a"), (9.5, "a"), (7.0, "b"), (7.0, "b"), (None, "a"), (3.0, None)]
    df = spark.createDataFrame(rows, "x double, k string")
    got = {(r["k"], r["point"]): r["density"] for r in prof.kde(df, "x", by="k", points=7).collect()}
    want = _direct([1, 2, 2, 9.5], 7)
    assert len(got) == 14
    assert all(abs(got["a", i] - want[i]) < 1e-9 for i in range(7))
    assert all(got["b", i] is None for i in range(7))


def test_one_series_and_more_values_than_a_block(spark):
    df = spark.range(3000).selectExpr("CAST(id * id % 7919 AS DOUBLE) AS x")
    got = [r["density"] for r in prof.kde(df, "x", points=50).orderBy("point").collect()]
    assert np.allclose(got, _direct([i * i % 7919 for i in range(3000)], 50), atol=1e-9)


def test_no_rows(spark):
    df = spark.createDataFrame([], "x double, k string")
    assert prof.kde(df, "x", by="k", points=5).collect() == []
