"""Statistical tests on small frames against textbook / brute-force values."""

import math

import numpy as np
from pyspark.sql import functions as F

from creditlens.functions import special
from creditlens.operators import stats


def test_chi_square_2x2_yates_and_3x2(spark):
    # 2x2: [[10, 20], [30, 40]] -> Yates-corrected chi2 = 0.44642857...
    rows = [("a", 0.0)] * 10 + [("a", 1.0)] * 20 + [("b", 0.0)] * 30 + [("b", 1.0)] * 40
    df = spark.createDataFrame(rows, "c string, target double")
    r = stats.chi_square(df, ["c"]).first()
    assert r["dof"] == 1
    obs = np.array([[10, 20], [30, 40]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    yates = (((np.abs(obs - exp) - 0.5) ** 2) / exp).sum()
    assert math.isclose(r["chi2_stat"], yates, rel_tol=1e-12)
    assert math.isclose(r["p_value"], special.chi2_sf(yates, 1), rel_tol=1e-12)
    # 3x2 with a zero cell: no correction
    rows = [("a", 0.0)] * 5 + [("b", 0.0)] * 7 + [("b", 1.0)] * 3 + [("c", 1.0)] * 9
    df = spark.createDataFrame(rows, "c string, target double")
    r = stats.chi_square(df, ["c"]).first()
    obs = np.array([[5, 0], [7, 3], [0, 9]], float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    assert r["dof"] == 2
    assert math.isclose(r["chi2_stat"], ((obs - exp) ** 2 / exp).sum(), rel_tol=1e-12)


def test_mann_whitney_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 120)
    x = rng.integers(0, 15, 120).astype(float)  # ties
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)], "target double, x double")
    r = stats.mann_whitney(df, ["x"], ranges=4).first()
    g0, g1 = x[y == 0], x[y == 1]
    u0 = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in g0 for b in g1)
    assert math.isclose(r["u_statistic"], u0, rel_tol=1e-12)
    n0, n1 = len(g0), len(g1)
    _, t = np.unique(x, return_counts=True)
    tie = float((t ** 3 - t).sum())
    n = n0 + n1
    sigma = math.sqrt(n0 * n1 / 12 * ((n + 1) - tie / (n * (n - 1))))
    z = (max(u0, n0 * n1 - u0) - n0 * n1 / 2 - 0.5) / sigma
    assert math.isclose(r["z"], z, rel_tol=1e-12)
    assert math.isclose(r["p_value"], min(1.0, math.erfc(z / math.sqrt(2))), rel_tol=1e-12)
    assert r["median_paid"] == float(np.median(g0)) and r["median_default"] == float(np.median(g1))


def test_point_biserial(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200).astype(float)
    x = rng.normal(size=200) + y
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)], "target double, x double")
    r = stats.point_biserial(df, ["x"]).first()
    rr = np.corrcoef(x, y)[0, 1]
    assert math.isclose(r["correlation"], rr, rel_tol=1e-9)
    t = rr * math.sqrt(198 / (1 - rr * rr))
    assert math.isclose(r["p_value"], special.t_two_sided_p(t, 198), rel_tol=1e-9)


def test_correlation_pairs_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.2, 0.0), (4.0, 7.9, 2.0)], "a double, b double, c double")
    p = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in stats.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert len(p) == 3
    assert math.isclose(p[("a", "c")], np.corrcoef([2, 3, 4], [1, 0, 2])[0, 1], rel_tol=1e-9)


def test_chi_square_matches_spark_ml_without_correction(spark):
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    rng = np.random.default_rng(12)
    rows = [(str(rng.choice(["a", "b", "c", "d"])), float(rng.integers(0, 2))) for _ in range(300)]
    df = spark.createDataFrame(rows, "c string, target double")
    ours = stats.chi_square(df, ["c"]).first()
    idx = StringIndexer(inputCol="c", outputCol="ci").fit(df).transform(df)
    vec = VectorAssembler(inputCols=["ci"], outputCol="f").transform(idx)
    ml = ChiSquareTest.test(vec, "f", "target").first()
    assert ours["dof"] == ml["degreesOfFreedom"][0]
    assert math.isclose(ours["chi2_stat"], float(ml["statistics"][0]), rel_tol=1e-9)
    assert math.isclose(ours["p_value"], float(ml["pValues"][0]), rel_tol=1e-6, abs_tol=1e-12)


def test_correlations_do_not_multiply_rows_and_merge_over_tasks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 3)) + 1e6
    x[:, 1] += x[:, 0]
    rows = [(float(a), float(b), None if i % 3 else float(c), 0.1, float("nan") if i == 7 else float(a)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, odd double").repartition(7)
    found = stats.correlation_pairs(df, df.columns)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.feature_1, r.feature_2): r.correlation for r in found.collect()}
    assert len(got) == 10
    assert math.isclose(got["a", "b"], np.corrcoef(x[:, 0], x[:, 1])[0, 1], rel_tol=1e-9)
    assert math.isclose(got["a", "c"], np.corrcoef(x[::3, 0], x[::3, 2])[0, 1], rel_tol=1e-9)
    assert got["a", "same"] is None and got["c", "same"] is None
    assert math.isnan(got["a", "odd"]) and not math.isnan(got["c", "odd"])  # row 7 has no c
    assert all(r.correlation is None for r in stats.correlation_pairs(df.limit(0), df.columns).collect())


def test_mann_whitney_ranks_the_values_once(spark, monkeypatch):
    from creditlens.operators import prefix

    names, written = [], prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, name: names.append(name) or written(df, name))
    rows = [(0.0, 1.0, None), (0.0, 2.0, 5.0), (0.0, 4.0, None), (0.0, 4.0, 1.0), (1.0, 3.0, None), (1.0, 9.0, None), (1.0, 1.0, None), (None, 7.0, 7.0)]
    df = spark.createDataFrame(rows, "target double, x double, y double")
    got = {r.feature: (r.n_paid, r.n_default, r.median_paid, r.median_default) for r in stats.mann_whitney(df, ["x", "y"]).collect()}
    assert got == {"x": (4, 3, 3.0, 3.0), "y": (2, 0, 3.0, None)}
    assert names.count("values") == 1
