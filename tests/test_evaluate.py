"""Evaluation operators: edge frames and metamorphic properties."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from creditlens.operators import evaluate as ev
from creditlens.operators.prefix import running_sums


def _frame(spark, y, s):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, target double, score double")


def _brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_edges(spark):
    assert ev.auc(_frame(spark, [0, 1, 0, 1], [0.3] * 4)).first()["auc"] == 0.5
    assert ev.auc(_frame(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()["auc"] == 1.0


def test_auc_matches_brute_force_and_is_rank_invariant(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.2, 2)  # many ties
    df = _frame(spark, y, s)
    a = ev.auc(df, ranges=7).first()["auc"]
    assert math.isclose(a, _brute_auc(y, s), rel_tol=1e-12)
    mono = df.withColumn("score", F.exp(F.col("score") * 3.0))
    assert math.isclose(ev.auc(mono, ranges=5).first()["auc"], a, rel_tol=1e-12)


def test_confusion_counts_and_zero_division(spark):
    df = _frame(spark, [0, 1, 0, 1], [0.1, 0.2, 0.3, 0.4])
    cm = ev.confusion(df, 0.9).first()
    assert cm["tp"] + cm["fp"] + cm["tn"] + cm["fn"] == 4
    assert cm["precision"] == 0.0 and cm["f2"] == 0.0


def test_sweep_matches_direct_confusion_and_is_monotone(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 3)
    s[:5] = [0.1, 0.35, 0.89, 0.9, 0.0999]
    df = _frame(spark, y, s)
    sw = ev.sweep(df).orderBy("threshold").toPandas()
    assert len(sw) == 80
    for _, row in sw.iloc[::7].iterrows():
        t = row["threshold"]
        tp = int(((s >= t) & (y == 1)).sum())
        fp = int(((s >= t) & (y == 0)).sum())
        assert (row["tp"], row["fp"]) == (tp, fp)
    assert (np.diff(sw["catch_rate"].to_numpy()) <= 1e-15).all()


def test_pr_curve_final_point_and_f2_choice(spark):
    df = _frame(spark, [0, 1, 1, 0, 1], [0.1, 0.4, 0.35, 0.8, 0.9])
    pr = ev.pr_curve(df).toPandas()
    end = pr[pr["threshold"].isna()].iloc[0]
    assert end["precision"] == 1.0 and end["recall"] == 0.0
    best = ev.f2_threshold(df).first()
    f2 = pr.dropna(subset=["threshold"])
    top = f2.sort_values(["f2", "threshold"], ascending=[False, True]).iloc[0]
    assert math.isclose(best["raw_threshold"], top["threshold"])


def test_running_sums_match_cumsum_with_keys(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "x": rng.permutation(500).astype(float), "v": rng.integers(0, 10, 500)})
    df = spark.createDataFrame(pdf)
    got = running_sums(df, "x", ["v"], keys=["k"], ranges=6).toPandas().sort_values(["k", "x"])
    exp = pdf.sort_values(["k", "x"]).groupby("k")["v"].cumsum()
    assert (got["v_cum"].to_numpy() == exp.to_numpy()).all()


def test_roc_thinning_matches_reference_rule_across_buckets(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 600)
    s = np.round(rng.random(600) * 0.3, 3)
    df = _frame(spark, y, s)
    got = ev.roc_curve_thinned(df, ranges=9).toPandas().sort_values("threshold", ascending=False)
    # reference rule on distinct scores in decreasing order
    ds = np.unique(s)[::-1]
    tps = np.cumsum([int(((s == v) & (y == 1)).sum()) for v in ds])
    fps = np.cumsum([int(((s == v) & (y == 0)).sum()) for v in ds])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = np.r_[np.inf, ds[keep]]
    assert np.array_equal(np.sort(got["threshold"].to_numpy()), np.sort(exp))


def test_exact_quantiles_match_numpy(spark):
    from creditlens.operators.prefix import exact_quantiles

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": rng.integers(0, 2, 401), "x": np.round(rng.random(401), 3)})
    df = spark.createDataFrame(pdf)
    got = {r["k"]: (r["q_0"], r["q_1"], r["q_2"]) for r in exact_quantiles(df, "x", [0.5, 0.95, 0.05], keys=["k"], ranges=5).collect()}
    for k, g in pdf.groupby("k"):
        for a, p in zip(got[k], (0.5, 0.95, 0.05)):
            assert math.isclose(a, float(np.quantile(g["x"], p)), rel_tol=1e-12)


def test_auc_equals_spark_ml_exact_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(10)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.random(500) * 0.6 + y * 0.2, 3)
    df = _frame(spark, y, s)
    ours = ev.auc(df, ranges=6).first()["auc"]
    ml = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="target", numBins=0).evaluate(df)
    assert math.isclose(ours, ml, rel_tol=1e-12)


def test_split_keeps_class_shares(spark):
    from creditlens.operators import features as fe

    rng = np.random.default_rng(11)
    y = (rng.random(997) < 0.23).astype(float)
    df = spark.createDataFrame([(str(i + 1), float(v)) for i, v in enumerate(y)], "id string, target double")
    out = fe.stratified_split(df, "target", 0.2, "id", rows_per_bucket=50).groupBy("target", "is_test").count().collect()
    n = {(r["target"], r["is_test"]): r["count"] for r in out}
    for c in (0.0, 1.0):
        tot = n[(c, True)] + n[(c, False)]
        assert abs(n[(c, True)] - 0.2 * tot) <= 0.5 + 1e-9


def test_column_quantiles_and_medians_match_numpy(spark):
    """Multi-column exact quantiles (bucketed ranks) equal numpy's linear interpolation, per group, nulls skipped."""
    import numpy as np

    from creditlens.operators.prefix import column_quantiles, medians

    rng = np.random.default_rng(7)
    rows = []
    for i in range(3000):
        k = int(rng.integers(0, 3))
        a = float(rng.integers(0, 40)) if k else float(rng.normal())  # ties in two groups, continuous in one
        b = None if i % 5 == 0 else float(rng.exponential())
        rows.append((k, a, b))
    df = spark.createDataFrame(rows, "k int, a double, b double")
    pdf = df.toPandas()
    got = {(r["k"], r["feature"]): (r["q_0"], r["q_1"]) for r in column_quantiles(df, ["a", "b"], [0.1, 0.99], keys=["k"], ranges=7).collect()}
    for (k, f), (q0, q1) in got.items():
        x = pdf.loc[pdf.k == k, f].dropna().to_numpy()
        assert math.isclose(q0, np.quantile(x, 0.1), rel_tol=1e-12, abs_tol=1e-12)
        assert math.isclose(q1, np.quantile(x, 0.99), rel_tol=1e-12, abs_tol=1e-12)
    assert len(got) == 6
    med = medians(df, ["a", "b"]).first()
    assert math.isclose(med["a"], float(np.median(pdf.a)), rel_tol=1e-12)
    assert math.isclose(med["b"], float(np.median(pdf.b.dropna())), rel_tol=1e-12)


def test_quantile_bins_count_the_cuts_below(spark):
    """_bin = number of quantiles below the value."""
    import numpy as np
    from pyspark.sql import functions as F

    from creditlens.operators.prefix import quantile_bins

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(v),) for v in rng.integers(0, 200, 3000)], "x double")
    for b in (3, 16, 50):
        got = quantile_bins(df, "x", b).toPandas()
        cuts = df.agg(F.percentile_approx("x", [i / b for i in range(1, b)], 10000)).first()[0]
        assert (np.searchsorted(np.array(cuts), got.x.to_numpy(), side="left") == got._bin.to_numpy()).all(), b


def test_overfull_ranges_are_divided(spark, monkeypatch):
    """Every range counts as too full, nulls come first, a series of one row stands among long ones."""
    import numpy as np

    from creditlens.operators import prefix

    monkeypatch.setattr(prefix, "OVERFULL", 0)
    rng = np.random.default_rng(6)
    x = rng.permutation(4000)[:3000]
    rows = [("a", float(v), 1 + int(v) % 3) for v in x] + [("b", 5.0, 7), ("c", None, 2), ("c", 1.0, 3)]
    df = spark.createDataFrame(rows, "k string, x double, v long")
    got = {(r.k, r.x): (r.v_cum, r.v_tot) for r in prefix.running_sums(df, "x", ["v"], ["k"], ranges=5).collect()}
    prev = {(r.k, r.x): r.prev_x for r in prefix.previous_values(df, "x", ["v"], ["k"], ranges=5).collect()}
    total, before = 0, None
    for v in sorted(x):
        total += 1 + int(v) % 3
        assert got["a", float(v)][0] == total and prev["a", float(v)] == before
        before = float(v)
    assert got["a", before] == (total, total) and got["b", 5.0] == (7, 7) and got["c", None] == (2, 5) and got["c", 1.0] == (5, 5)
