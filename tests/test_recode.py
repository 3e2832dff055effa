"""Semantics that differ from a naive port (README, 'Semantics'), on hand frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from creditlens.functions import recode as rc
from creditlens.operators import features as fe
from creditlens.operators import labelling, profile, stats


def test_null_status_kept_and_default_dropped(spark):
    df = spark.createDataFrame([(None,), ("Default",), ("Current",), ("Fully Paid",), ("Charged Off",), ("Other",)], "loan_status string")
    out = {r["loan_status"]: r["target"] for r in labelling.label_target(df).collect()}
    assert set(out) == {None, "Fully Paid", "Charged Off", "Other"}
    assert out[None] is None and out["Other"] is None
    assert out["Fully Paid"] == 0.0 and out["Charged Off"] == 1.0


def test_flag_of_missing_count_is_zero(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "pub_rec double")
    assert [r[0] for r in df.select(rc.positive_flag("pub_rec")).collect()] == [0, 0, 1]


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (7.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(rc.clip_keep_null("x", 0.0, 5.0)).collect()] == [None, 0.0, 5.0, 2.0]


def test_exact_quantile_interpolates(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    v = df.agg(profile.quantile_expr("x", 0.99)).first()[0]
    assert math.isclose(v, 9.79, rel_tol=1e-12)
    assert df.agg(F.median("x")).first()[0] == 2.5


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    stats_ = fe.fit_imputer(df, [], ["c"])
    assert stats_["mode"]["c"] == "a"
    assert [r[0] for r in fe.apply_imputer(df, stats_).collect()].count("a") == 3


def test_scaler_population_deviation_and_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (2.0, 1.0, 5.0), (3.0, 1.0, 5.0), (6.0, 0.0, 5.0)], "a double, flag double, const double")
    st = fe.fit_scaler(df, ["a", "flag", "const"])
    assert set(st["mean"]) == {"a"}  # flag has 2 values, const 1 value
    vals = np.array([1.0, 2.0, 3.0, 6.0])
    assert math.isclose(st["std"]["a"], vals.std(ddof=0), rel_tol=1e-12)
    zero = fe.fit_scaler(spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "z double"), ["z"])
    assert zero["mean"] == {}


def test_one_hot_drops_alphabetically_first(spark):
    df = spark.createDataFrame([("RENT",), ("ANY",), ("OWN",)], "home string")
    lv = fe.fit_levels(df, ["home"])
    assert lv["home"] == ["ANY", "OWN", "RENT"]
    out = fe.apply_one_hot(df, lv)
    assert out.columns == ["home_OWN", "home_RENT"]
    assert [tuple(r) for r in out.collect()] == [(0, 1), (0, 0), (1, 0)]


def test_vif_is_uncentred(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(5, 2, size=(300, 3))
    x[:, 2] = x[:, 0] * 0.7 + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = {r["feature"]: r["VIF"] for r in stats.vif(df, ["a", "b", "c"], digits=8).collect()}
    for i, name in enumerate("abc"):
        y = x[:, i]
        others = np.delete(x, i, axis=1)
        beta, *_ = np.linalg.lstsq(others, y, rcond=None)
        resid = y - others @ beta
        r2 = 1 - (resid @ resid) / (y @ y)  # no intercept: uncentred R²
        assert math.isclose(got[name], 1 / (1 - r2), rel_tol=1e-6)


def test_history_years_fixed_end(spark):
    df = spark.createDataFrame([("Jan-2000",), ("bad",)], "t string")
    out = [r[0] for r in df.select(rc.years_until(rc.month_text_to_date("t"))).collect()]
    assert math.isclose(out[0], (np.datetime64("2018-12-31") - np.datetime64("2000-01-01")).astype(int) / 365)
    assert out[1] is None


def test_case_else_catches_null(spark):
    df = spark.createDataFrame([(None,), (20000.0,), (1e6,)], "inc double")
    out = [r[0] for r in df.select(rc.bucket("inc", rc.INCOME_BOUNDS, rc.INCOME_LABELS)).collect()]
    assert out == ["6. >$150K", "1. <$30K", "6. >$150K"]


def test_percent_text_and_null_words(spark):
    df = spark.createDataFrame([("25.5%",), (" 7 % ",), ("n/a",), ("NaN",), ("-1%",)], "t string")
    out = [r[0] for r in df.select(rc.percent_text(rc.null_words_to_null("t"))).collect()]
    assert out == [25.5, 7.0, None, None, -1.0]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (4.0,)], "x double")
    h = {r["bin"]: r["count"] for r in profile.histogram(df, "x", 4, density=False).collect()}
    assert h == {0: 1, 1: 1, 2: 1, 3: 1}
    d = profile.histogram(df, "x", 4, density=True).agg(F.sum(F.col("density") * (F.col("bin_hi") - F.col("bin_lo")))).first()[0]
    assert math.isclose(d, 1.0)


def test_half_open_bands(spark):
    df = spark.createDataFrame([(300.0,), (579.0,), (580.0,), (850.0,), (299.0,)], "s double")
    out = [r[0] for r in df.select(rc.half_open_band("s")).collect()]
    assert out == ["Very Poor (<580)", "Very Poor (<580)", "Fair (580-669)", "Exceptional (800+)", None]
