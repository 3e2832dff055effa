"""One class, constant columns, given ranges and large counts: a defined result instead of a failure."""

import pytest
from pyspark.sql import functions as F

from creditlens.operators import evaluate as ev
from creditlens.operators import profile as pr
from creditlens.operators import stats as st


def test_one_class_only(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0)], "score double, target double")
    assert ev.confusion(df, 0.3).first().catch_rate is None
    assert ev.auc(df).first().auc is None
    assert {r.tpr for r in ev.roc_curve(df).collect()} == {None, 0.0}
    assert ev.pr_curve(df).count() == 3
    ev.f2_threshold(df).collect()


def test_reports_without_defaults_or_rows(spark):
    df = spark.createDataFrame([(0.1, 0.0), (0.4, 0.0)], "score double, target double")
    r = ev.business_impact(ev.confusion(df, 0.3)).first()
    assert (r.total, r.default_rate_no_model, r.default_rate_reduction, r.good_approved_rate) == (2, 0.0, None, 0.5)
    assert ev.business_impact(ev.confusion(df.limit(0), 0.3)).first().default_rate_no_model is None
    assert ev.classification_report(ev.confusion(df.limit(0), 0.3)).where("f1 != 0").isEmpty()


def test_auc_of_large_counts(spark):
    rows = [(0.1, 0.0), (0.2, 1.0), (0.2, 0.0), (0.3, 1.0)]
    df = spark.createDataFrame(rows, "score double, target double")
    small = ev.auc(df).first().auc
    base = ev._curve_base(df, "score", "target", [], None)
    big = 4_000_000_000
    grown = base.select("n_pos", "neg_below", "n_neg").select(*[(F.col(c) * big).alias(c) for c in ("n_pos", "neg_below", "n_neg")])
    total = grown.agg(F.sum(F.col("n_pos").cast("double") * (F.col("neg_below") + F.col("n_neg") / 2.0))).first()[0]
    assert small == pytest.approx(total / (2.0 * big) ** 2)


def test_histogram_in_a_given_range(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    rows = pr.histogram(df, "x", 5, lo=0.0, hi=4.0).collect()
    assert sum(r["count"] for r in rows) == 5
    assert sum(r.density * (r.bin_hi - r.bin_lo) for r in rows) == pytest.approx(1.0)


def test_histogram_of_a_constant(spark):
    rows = sorted(pr.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 2).collect(), key=lambda r: r.bin)
    assert [r["count"] for r in rows] == [0, 4] and (rows[0].bin_lo, rows[-1].bin_hi) == (2.5, 3.5)


def test_constant_and_perfect_columns(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2), 1.0, float(i)) for i in range(20)], "target double, same double, flat double, x double")
    got = {r.feature: r for r in st.point_biserial(df, ["same", "flat", "x"], with_p=False).collect()}
    assert got["same"].t_stat is None and got["x"].t_stat is not None
    u = {r.feature: r for r in st.mann_whitney(df, ["flat", "x"], with_p=False).collect()}
    assert u["flat"].z is None and u["x"].z is not None
