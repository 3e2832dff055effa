"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full through Spark's no-op sink (every row
materialised, nothing collected to the driver).  Prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
plus rows/s for the row-heavy operators.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # SQL questions and summary
    "portfolio_summary", "q1_grade", "q2_states_by_volume", "q3_purpose_risk", "q4_yearly_trend", "q5_income_brackets",
    "q6_running_totals", "q7_segment_profile", "q8_dti_buckets", "q9_grade_purpose_top", "q9_grade_purpose_matrix",
    # profiling
    "null_audit", "describe_exact", "histogram_dti", "kde_dti", "hypothesis_summary", "engineered_features",
    # population study
    "rejected_per_year", "state_rejection", "employment_compare", "score_bands",
    # evaluation
    "auc_exact", "roc_curve", "threshold_sweep", "f2_threshold", "business_impact",
    # statistics
    "point_biserial", "mann_whitney_u", "chi_square_stat", "correlation_pairs", "vif",
    # preparation, models, explanation
    "prepared_features", "boosted_invariants", "model_evaluation", "shap_additivity", "shap_mean_abs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]

    from creditlens.plans.registry import load_all
    from creditlens.session import checkpoint_dir, local_session
    from creditlens.sources.tables import scale_factor

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="creditlens-bench")
    checkpoint_dir(spark)
    reg = load_all()
    # warm the JVM on the smallest data (not timed)
    reg["q1_grade"].build(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in (only or HEADLINE):
        t0 = time.time()
        df = reg[name].build(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    # input sizes for throughput figures
    from creditlens.plans import inputs

    n_loans = inputs.loans(spark, sf_dir).count()
    n_rej = inputs.rejected(spark, sf_dir).count()
    n_scored = inputs.scored(spark, sf_dir).count()
    rows.update(loans=n_loans, rejected=n_rej, scored=n_scored)
    tput = {}
    for q, n in (("rejected_per_year", n_rej), ("threshold_sweep", n_scored), ("auc_exact", n_scored),
                 ("mann_whitney_u", n_loans * 16)):
        if q in times and times[q] > 0:
            tput[q] = round(n / times[q], 1)
    out = {
        "metric": "total_wall_time_headline_queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": scale_factor(sf_dir),
        "cpus": int(cpus),
        "rows": rows,
        "rows_per_sec": tput,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
