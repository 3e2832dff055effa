"""Tree attributions against brute-force Shapley enumeration of the
path-dependent (cover-weighted) value function."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditlens.operators import explain as ex


def _data(spark, n=400, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(0, 0.5, n)) > 0).astype(float)
    rows = [(str(i), float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, target double, a double, b double, c double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), x


def _expected(tree, node, x, s):
    """E[f(x) | x_S] under the trees' cover distribution (value function of path-dependent SHAP)."""
    left, right, f, thr, cov, val = tree[node]
    if left < 0:
        return val
    if f in s:
        return _expected(tree, left if x[f] <= thr else right, x, s)
    cl, cr = tree[left][4], tree[right][4]
    return (cl * _expected(tree, left, x, s) + cr * _expected(tree, right, x, s)) / (cl + cr)


def _trees(spark, model, kind):
    nodes = ex._read_nodes(spark, model)
    out = []
    for _, t in nodes.groupby("treeID"):
        tree = {}
        for _, r in t.iterrows():
            st = list(r["impurityStats"])
            cov = float(sum(st)) if kind == "rf" else float(st[0])
            val = (st[1] / sum(st)) if kind == "rf" else float(r["prediction"])
            thr = float(r["leftCategoriesOrThreshold"][0]) if r["leftChild"] >= 0 else 0.0
            tree[int(r["id"])] = (int(r["leftChild"]), int(r["rightChild"]), int(r["featureIndex"]), thr, cov, val)
        out.append(tree)
    return out


@pytest.mark.parametrize("kind", ["gbt", "rf"])
def test_shap_equals_brute_force(spark, kind, monkeypatch):
    df, x = _data(spark)
    if kind == "gbt":
        m = GBTClassifier(labelCol="target", maxIter=4, maxDepth=3, seed=1).fit(df)
        w = [2.0 * v for v in m.treeWeights]
    else:
        m = RandomForestClassifier(labelCol="target", numTrees=3, maxDepth=3, seed=1).fit(df)
        w = [1.0 / 3] * 3
    t = ex.leaf_tables(spark, m, kind)
    trees = _trees(spark, m, kind)
    rows = x[:6]
    phi = ex.shap_batch(rows, ex.pattern_tables(t), 3)
    assert np.abs(phi - ex.dense_batch(rows, t, 3)).max() < 1e-9
    monkeypatch.setattr(ex, "TABLED", 1)
    assert np.abs(phi - ex.shap_batch(rows, ex.pattern_tables(t), 3)).max() < 1e-9  # deeper leaves row by row
    feats = [0, 1, 2]
    for i, xi in enumerate(rows):
        def v(s):
            return sum(wt * _expected(tr, 0, xi, set(s)) for wt, tr in zip(w, trees))
        for f in feats:
            others = [g for g in feats if g != f]
            tot = 0.0
            for k in range(len(others) + 1):
                for s in itertools.combinations(others, k):
                    wgt = math.factorial(k) * math.factorial(len(feats) - k - 1) / math.factorial(len(feats))
                    tot += wgt * (v(s + (f,)) - v(s))
            assert math.isclose(phi[i, f], tot, abs_tol=1e-12), (kind, i, f, phi[i, f], tot)
        assert math.isclose(t["base"] + phi[i].sum(), v(feats), abs_tol=1e-12)


def test_shap_job_adds_up_to_log_odds(spark):
    df, _ = _data(spark, 300, 9)
    m = GBTClassifier(labelCol="target", maxIter=6, maxDepth=4, seed=2).fit(df)
    shap = ex.shap_values(df.select("id", "a", "b", "c"), m, ["a", "b", "c"])
    raw = m.transform(df).select("id", (F.lit(2.0) * vector_to_array("rawPrediction")[1]).alias("f"))
    err = shap.join(raw, "id").agg(F.max(F.abs(F.col("margin") - F.col("f")))).first()[0]
    assert err < 1e-9
    assert shap.count() == 300


def test_shap_chunked_broadcast_equals_single_broadcast(spark):
    """A model larger than the broadcast limit is explained in chained leaf ranges; the sum is the same."""
    df, _ = _data(spark, 200, 11)
    m = GBTClassifier(labelCol="target", maxIter=5, maxDepth=3, seed=4).fit(df)
    data = df.select("id", "a", "b", "c")
    one = ex.shap_values(data, m, ["a", "b", "c"])
    t = ex.leaf_tables(spark, m)
    small = ex.split_tables(t, 3 * (sum(t[k][:1].nbytes for k in ex.LEAF_ARRAYS) + 8 * t["dlen"].max() * 2 ** int(t["dlen"].max())))
    assert len(small) > 3
    many = ex.shap_values(data, m, ["a", "b", "c"], max_broadcast_bytes=3 * sum(t[k][:1].nbytes for k in ex.LEAF_ARRAYS))
    assert "base_value" in many.columns and many.columns == one.columns
    cols = ["shap_a", "shap_b", "shap_c", "margin"]
    j = one.select("id", *[F.col(c).alias(f"o_{c}") for c in cols]).join(many, "id")
    err = j.agg(F.max(F.greatest(*[F.abs(F.col(f"o_{c}") - F.col(c)) for c in cols]))).first()[0]
    assert err < 1e-12
    assert j.count() == 200


def test_dependence_finds_the_partner_not_a_correlated_column(spark):
    """b follows the main feature a and so its attribution; c changes the attribution at a given a."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=1500)
    b, c, d = a + rng.normal(0, 0.05, 1500), rng.normal(size=1500), np.ones(1500)
    rows = [(str(i), *map(float, x)) for i, x in enumerate(zip(a, b, c, d, a + 0.2 * c))]
    shap = spark.createDataFrame(rows, "id string, a double, b double, c double, d double, shap_a double")
    out = ex.dependence(shap, ["a", "b", "c", "d"], "a")
    assert out.count() == 1500 and out.columns == ["id", "value", "shap", "interaction_feature"]
    assert {r[0] for r in out.select("interaction_feature").distinct().collect()} == {"c"}


def test_dependence_query_returns_both_top_features(spark, monkeypatch):
    from creditlens.plans import q_explain

    rows = [(str(i), float(i % 7), float(i % 5), float(i % 3), float(i % 7), 0.5 * (i % 5), 0.1 * (i % 3)) for i in range(200)]
    shap = spark.createDataFrame(rows, "id string, a double, b double, c double, shap_a double, shap_b double, shap_c double")
    monkeypatch.setattr(q_explain, "_shap", lambda *_: (shap, None, ["a", "b", "c"], None, None))
    got = q_explain.shap_dependence(spark, "sf").groupBy("feature").count().collect()
    assert {r["feature"]: r["count"] for r in got} == {"a": 200, "b": 200}
