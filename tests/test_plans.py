"""Plan-shape checks: pruned scans, no single-partition exchange under row-level
aggregates for the rank operators, broadcast of bounded small sides."""

from creditlens.operators import evaluate as ev
from creditlens.operators import stats
from creditlens.plans import inputs
from creditlens.plans.q_stats import significance_table

from .conftest import SF_SMALL


def _plan(df):
    """The text ``df.explain("formatted")`` prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_q1_scan_is_pruned(spark):
    from creditlens.operators import segments

    plan = _plan(segments.risk_by_grade(inputs.loans_sql(spark, SF_SMALL)))
    # Q1 reads the written loan table and only the five columns it needs
    schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert schema and all("revol_bal" not in ln and "issue_d" not in ln for ln in schema)
    assert any("grade:string" in ln and "target:double" in ln for ln in schema)
    assert "PushedFilters: [IsNotNull(grade)]" in plan
    assert "partial_avg" in plan  # map-side combine before the shuffle


def test_fixture_derivation_prunes_and_broadcasts_dimensions(spark):
    from creditlens.operators.labelling import label_target
    from creditlens.sources import fixtures

    df = label_target(fixtures.raw_loans(spark, SF_SMALL)).groupBy("grade").count()
    plan = _plan(df)
    orders = [ln for ln in plan.splitlines() if "ReadSchema: struct<o_orderkey" in ln]
    # status and grade need key, customer, status and priority — not the date or price
    assert orders and all("o_orderdate" not in ln and "o_totalprice" not in ln for ln in orders)
    assert "BroadcastHashJoin" in plan  # nation / customer are small here; Spark sizes them itself


def test_auc_has_no_single_partition_window_over_rows(spark):
    df = ev.auc(inputs.scored(spark, SF_SMALL))
    plan = _plan(df)
    opt = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [ln for ln in opt.splitlines() if "Window [" in ln]
    # the running sum over distinct scores is partitioned by range; the one
    # unpartitioned window runs over the table of range totals
    assert any("_range" in ln for ln in windows)
    assert "percentile_approx" not in plan.lower() and "approx_percentile" not in plan.lower()
    assert "BroadcastHashJoin" in plan or "SortMergeJoin" in plan


def test_mann_whitney_windows_are_partitioned(spark):
    t = significance_table(spark, SF_SMALL)
    mw = stats.mann_whitney(t, ["dti", "loan_amnt"], with_p=False)
    plan = mw._jdf.queryExecution().optimizedPlan().toString()
    windows = [ln for ln in plan.splitlines() if "Window [" in ln]
    assert windows
    # every window over value ranks is partitioned by feature (and bucket)
    assert all("feature" in ln for ln in windows)


def test_bounded_sides_are_broadcast(spark):
    from creditlens.operators import profile

    df = profile.histogram(inputs.loans(spark, SF_SMALL), "dti", 50, by="target")
    df.collect()
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_statistics_enter_as_scalars_not_cross_joins(spark):
    """One-row statistics (totals, caps, ranges, cut-offs) are scalar subqueries;
    per-series statistics join on the series keys.  No registered query of the
    data-level kind plans a nested-loop or Cartesian join."""
    from creditlens.plans.registry import load_all

    reg = load_all()
    names = ["funnel", "score_bands", "employment_compare", "frequency_purpose", "histogram_dti", "kde_dti", "box_dti",
             "hypothesis_summary", "engineered_features", "threshold_sweep", "constrained_threshold", "roc_curve_thinned",
             "auc_exact", "f2_threshold", "business_impact", "classification_report", "model_comparison", "class_weights", "mann_whitney_u"]
    for name in [n for n in names if n in reg]:
        plan = _plan(reg[name].build(spark, SF_SMALL))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_f2_threshold_per_series_is_an_aggregate(spark):
    """With series keys the arg-max is a partial aggregate, not a window over a series."""
    from pyspark.sql import functions as F

    sc = inputs.scored(spark, SF_SMALL)
    two = sc.select("score", "target", F.lit("a").alias("model")).unionByName(
        sc.select((F.col("score") * 0.5).alias("score"), "target", F.lit("b").alias("model")))
    plan = _plan(ev.f2_threshold(two, keys=["model"]))
    assert "partial_max_by" in plan
    got = {r["model"]: r["raw_threshold"] for r in ev.f2_threshold(two, keys=["model"]).collect()}
    alone = ev.f2_threshold(sc).first()["raw_threshold"]
    assert abs(got["a"] - alone) < 1e-12 and abs(got["b"] - alone * 0.5) < 1e-12


def test_exact_quantiles_merge_no_value_map_in_one_task(spark):
    """describe / class medians / caps use the bucketed rank job, not Spark's
    value->count ``percentile`` state merged per group."""
    from creditlens.plans.registry import load_all

    reg = load_all()
    for name in ("describe_exact", "hypothesis_summary", "income_quantiles", "box_dti", "dti_populations"):
        if name in reg:
            plan = _plan(reg[name].build(spark, SF_SMALL))
            assert "percentile(" not in plan, name


def test_models_are_fitted_at_the_operators_defaults(spark, monkeypatch):
    """Registered queries pass no sizes of their own, and the saved cut-off is the model's own."""
    from types import SimpleNamespace

    from creditlens.plans import modelling as md
    from creditlens.plans import q_models

    given = {}
    writer = lambda: SimpleNamespace(save=lambda path: None)
    fit = lambda name: lambda train, **sizes: given.update({name: sizes}) or SimpleNamespace(write=writer)
    monkeypatch.setattr(md, "_MEMO", {})
    monkeypatch.setattr(md, "train_test", lambda *a: (None, None, None))
    monkeypatch.setattr(md.mo, "fit_forest", fit("forest"))
    monkeypatch.setattr(md.mo, "fit_boosted", fit("boosted"))
    md.model(spark, "sf", "forest")
    md.model(spark, "sf", "boosted")
    assert given == {"forest": {}, "boosted": {}}
    assert "boosted_f2_threshold" in q_models.persistence_roundtrip.__code__.co_names
