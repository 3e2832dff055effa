"""Registered profiling / recode queries over the labelled loan table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import scalar_values
from ..operators.prefix import exact_quantiles
from ..functions.recode import DROP_STATUSES, STATUS_TARGET, clip_keep_null, exclude_keep_null, month_text_to_date, recode, years_until
from ..operators import profile as prof
from ..sources import fixtures
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

RAW = oracle_views(("raw_loans",))
LOANS = oracle_views(("loans",))

AUDIT_COLS = ["loan_status", "loan_amnt", "int_rate", "installment", "grade", "emp_length", "home_ownership",
              "verification_status", "annual_inc", "purpose", "addr_state", "dti", "pub_rec", "open_acc",
              "total_acc", "revol_bal", "revol_util", "mort_acc", "delinq_2yrs", "inq_last_6mths", "target"]
DESCRIBE_COLS = ["loan_amnt", "int_rate", "annual_inc", "dti", "revol_util"]
NUMERIC_COLS = ["loan_amnt", "int_rate", "installment", "annual_inc", "dti", "pub_rec", "open_acc", "total_acc",
                "revol_bal", "revol_util", "mort_acc", "delinq_2yrs", "inq_last_6mths"]


def _union(parts):
    return "\nUNION ALL ".join(parts)


@query("label_target", oracle=LOANS + "SELECT CAST(id AS VARCHAR) AS id, loan_status, target FROM loans")
def label_target(spark, sf_dir):
    return inputs.loans(spark, sf_dir).select("id", "loan_status", "target")


_drop = ", ".join(f"'{s}'" for s in DROP_STATUSES)
_map = " ".join(f"WHEN '{k}' THEN {v}.0E0" for k, v in STATUS_TARGET.items())


@query("status_table", oracle=RAW + f"""
SELECT loan_status, COUNT(*) AS n, ROUND(100.0E0 * COUNT(*) / SUM(COUNT(*)) OVER (), 2) AS pct,
       CASE loan_status {_map} END AS target, loan_status NOT IN ({_drop}) AS kept
FROM raw_loans WHERE loan_status IS NOT NULL GROUP BY loan_status""")
def status_table(spark, sf_dir):
    """Status counts and shares of the raw table, with the class each maps to."""
    freq = prof.frequency(fixtures.raw_loans(spark, sf_dir), "loan_status")
    return freq.select(
        "loan_status", "n", F.round(F.col("share") * 100.0, 2).alias("pct"),
        recode("loan_status", STATUS_TARGET).cast("double").alias("target"),
        exclude_keep_null("loan_status", DROP_STATUSES).alias("kept"),
    )


@query("null_audit", oracle=LOANS + _union(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS row_count FROM loans" for c in AUDIT_COLS))
def null_audit(spark, sf_dir):
    return prof.null_audit(inputs.loans(spark, sf_dir), AUDIT_COLS)


@query("frequency_purpose", oracle=LOANS + """
SELECT purpose, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM loans WHERE purpose IS NOT NULL GROUP BY purpose""")
def frequency_purpose(spark, sf_dir):
    return prof.frequency(inputs.loans(spark, sf_dir), "purpose")


@query("frequency_target", oracle=LOANS + """
SELECT target, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share FROM loans WHERE target IS NOT NULL GROUP BY target""")
def frequency_target(spark, sf_dir):
    return prof.frequency(inputs.loans(spark, sf_dir), "target")


@query("group_stats_dti", oracle=LOANS + """
SELECT target, COUNT(dti) AS dti_count, ROUND(AVG(dti), 9) AS dti_mean, ROUND(MEDIAN(dti), 9) AS dti_median
FROM loans WHERE target IS NOT NULL GROUP BY target""")
def group_stats_dti(spark, sf_dir):
    g = prof.group_stats(inputs.loans(spark, sf_dir), "target", "dti")
    return g.withColumn("dti_mean", F.round("dti_mean", 9)).withColumn("dti_median", F.round("dti_median", 9))


@query("pub_rec_first_groups", oracle=LOANS + """
SELECT pub_rec, ROUND(AVG(target), 9) AS target_mean FROM loans WHERE pub_rec IS NOT NULL
GROUP BY pub_rec ORDER BY pub_rec LIMIT 8""")
def pub_rec_first_groups(spark, sf_dir):
    g = prof.first_groups(inputs.loans(spark, sf_dir), "pub_rec", "target", 8)
    return g.withColumn("target_mean", F.round("target_mean", 9))


@query("crosstab_purpose_target", oracle=LOANS + """
SELECT purpose, COUNT(*) FILTER (WHERE target = 0) AS n_paid, COUNT(*) FILTER (WHERE target = 1) AS n_default
FROM loans WHERE purpose IS NOT NULL AND target IS NOT NULL GROUP BY purpose""")
def crosstab_purpose_target(spark, sf_dir):
    ct = prof.crosstab_counts(inputs.loans(spark, sf_dir), "purpose", "target", [0.0, 1.0])
    return ct.select("purpose", F.col("`0.0`").alias("n_paid"), F.col("`1.0`").alias("n_default"))


@query("income_quantiles", oracle=LOANS + """
SELECT 'all' AS scope, ROUND(QUANTILE_CONT(annual_inc, 0.99), 9) AS p99, ROUND(MEDIAN(annual_inc), 9) AS p50 FROM loans
UNION ALL SELECT CAST(target AS VARCHAR) AS scope, ROUND(QUANTILE_CONT(annual_inc, 0.99), 9) AS p99, ROUND(MEDIAN(annual_inc), 9) AS p50
FROM loans WHERE target IS NOT NULL GROUP BY target""")
def income_quantiles(spark, sf_dir):
    """Global and per-class exact quantiles."""
    loans = inputs.loans(spark, sf_dir)
    both = lambda q: q.select(F.round("q_0", 9).alias("p99"), F.round("q_1", 9).alias("p50"))
    overall = both(exact_quantiles(loans, "annual_inc", [0.99, 0.5])).select(F.lit("all").alias("scope"), "p99", "p50")
    per = exact_quantiles(loans.filter(F.col("target").isNotNull()), "annual_inc", [0.99, 0.5], keys=["target"])
    per = per.select(F.col("target").cast("string").alias("scope"), F.round("q_0", 9).alias("p99"), F.round("q_1", 9).alias("p50"))
    return overall.unionByName(per)


@query("describe_exact", oracle=LOANS + _union(
    f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
       CAST(MIN({c}) AS DOUBLE) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 9) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 9) AS p50,
       ROUND(QUANTILE_CONT({c}, 0.75), 9) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM loans""" for c in DESCRIBE_COLS))
def describe_exact(spark, sf_dir):
    d = prof.describe_exact(inputs.loans(spark, sf_dir), DESCRIBE_COLS)
    for c, digits in (("mean", 6), ("std", 6), ("p25", 9), ("p50", 9), ("p75", 9)):
        d = d.withColumn(c, F.round(c, digits))
    return d


_HIST = LOANS.rstrip() + """,
d AS (SELECT target, CAST(dti AS DOUBLE) AS x FROM loans WHERE dti IS NOT NULL AND target IS NOT NULL),
r AS (SELECT target, MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, (MAX(x) - MIN(x)) / 50.0E0 AS w FROM d GROUP BY target),
c AS (SELECT d.target, CASE WHEN r.hi = r.lo THEN 0 ELSE LEAST(49, CAST(FLOOR((d.x - r.lo) / (r.hi - r.lo) * 50.0E0) AS INT)) END AS bin,
             COUNT(*) AS cnt FROM d JOIN r ON d.target = r.target GROUP BY ALL),
b AS (SELECT r.target, g.bin, r.lo, r.w, r.n FROM r, (SELECT CAST(range AS INT) AS bin FROM range(50)) g)
SELECT b.target, b.bin, b.lo + b.bin * b.w AS bin_lo, b.lo + (b.bin + 1) * b.w AS bin_hi,
       COALESCE(c.cnt, 0) AS count, COALESCE(c.cnt, 0) / (b.n * b.w) AS density
FROM b LEFT JOIN c ON b.target = c.target AND b.bin = c.bin"""


@query("histogram_dti", oracle=_HIST)
def histogram_dti(spark, sf_dir):
    return prof.histogram(inputs.loans(spark, sf_dir), "dti", 50, by="target", density=True)


_KDE = LOANS.rstrip() + """,
d AS (SELECT target, CASE WHEN dti < 0 THEN 0E0 WHEN dti > 60 THEN 60E0 ELSE dti END AS x FROM loans
      WHERE dti IS NOT NULL AND target IS NOT NULL),
s AS (SELECT target, COUNT(*) AS n, STDDEV_SAMP(x) * POW(CAST(COUNT(*) AS DOUBLE), -0.2) AS h,
             MIN(x) - 0.5E0 * (MAX(x) - MIN(x)) AS g0, (2.0E0 * (MAX(x) - MIN(x))) / 999.0E0 AS step FROM d GROUP BY target),
v AS (SELECT target, x, COUNT(*) AS w FROM d GROUP BY target, x),
g AS (SELECT CAST(range AS INT) AS point FROM range(1000))
SELECT s.target, g.point, s.g0 + CAST(g.point AS DOUBLE) * s.step AS x,
       ROUND(SUM(v.w * EXP(-0.5E0 * POW(((s.g0 + CAST(g.point AS DOUBLE) * s.step) - v.x) / s.h, 2.0E0)))
             / (s.n * s.h * SQRT(2 * PI())), 10) AS density
FROM s JOIN v ON s.target = v.target CROSS JOIN g
GROUP BY s.target, g.point, s.g0, s.step, s.n, s.h"""


@query("kde_dti", oracle=_KDE)
def kde_dti(spark, sf_dir):
    """Density curve of DTI (clipped to 0..60) per class."""
    loans = inputs.loans(spark, sf_dir).filter(F.col("target").isNotNull())
    clipped = loans.select("target", clip_keep_null("dti", 0.0, 60.0).alias("dti"))
    return prof.kde(clipped, "dti", by="target", points=1000)


_BOX = LOANS.rstrip() + """,
d AS (SELECT target, CAST(dti AS DOUBLE) AS x FROM loans WHERE dti IS NOT NULL AND target IS NOT NULL),
q AS (SELECT target, QUANTILE_CONT(x, 0.25) AS q1, MEDIAN(x) AS median, QUANTILE_CONT(x, 0.75) AS q3 FROM d GROUP BY target)
SELECT q.target, ROUND(q1, 9) AS q1, ROUND(median, 9) AS median, ROUND(q3, 9) AS q3, ROUND(q3 - q1, 9) AS iqr,
       MIN(CASE WHEN x >= q1 - 1.5 * (q3 - q1) THEN x END) AS whisker_lo,
       MAX(CASE WHEN x <= q3 + 1.5 * (q3 - q1) THEN x END) AS whisker_hi,
       COUNT(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers, COUNT(*) AS n
FROM d JOIN q ON d.target = q.target GROUP BY q.target, q1, median, q3"""


@query("box_dti", oracle=_BOX)
def box_dti(spark, sf_dir):
    loans = inputs.loans(spark, sf_dir).filter(F.col("target").isNotNull())
    b = prof.box_stats(loans, "dti", by="target")
    return b.select("target", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3", "iqr")],
                    "whisker_lo", "whisker_hi", "outliers", "n")


@query("distinct_counts", oracle=LOANS + _union(
    f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct FROM loans" for c in NUMERIC_COLS))
def distinct_counts(spark, sf_dir):
    return prof.distinct_counts(inputs.loans(spark, sf_dir), NUMERIC_COLS)


_ENG = LOANS.rstrip() + """,
cap AS (SELECT QUANTILE_CONT(annual_inc, 0.99) AS c FROM loans)
SELECT CAST(id AS VARCHAR) AS id,
       DATE_DIFF('day', earliest_cr_date, DATE '2018-12-31') / 365.0E0 AS credit_history_years,
       CASE WHEN pub_rec > 0 THEN 1 ELSE 0 END AS has_derogatory,
       CASE WHEN annual_inc IS NULL THEN NULL WHEN annual_inc < 0 THEN 0E0 WHEN annual_inc > cap.c THEN cap.c ELSE annual_inc END AS annual_inc,
       CAST(CASE emp_length WHEN '< 1 year' THEN 0 WHEN '1 year' THEN 1 WHEN '10+ years' THEN 10
            ELSE TRY_CAST(SUBSTR(emp_length, 1, 1) AS INT) END AS DOUBLE) AS emp_length,
       CAST(NULLIF(STRPOS('ABCDEFG', grade), 0) AS DOUBLE) AS grade, target
FROM loans, cap"""


@query("engineered_features", oracle=_ENG)
def engineered_features(spark, sf_dir):
    """P8-P12 + ordinal recodes + income cap (clip keeps null)."""
    e = prof.engineer(inputs.loans(spark, sf_dir))
    return e.select("id", "credit_history_years", "has_derogatory", "annual_inc", "emp_length", "grade", "target")


_HYP = LOANS.rstrip() + """,
cap AS (SELECT QUANTILE_CONT(annual_inc, 0.99) AS c FROM loans),
e AS (SELECT target, dti, pub_rec, DATE_DIFF('day', earliest_cr_date, DATE '2018-12-31') / 365.0E0 AS chy,
             CASE WHEN annual_inc IS NULL THEN NULL WHEN annual_inc < 0 THEN 0E0 WHEN annual_inc > cap.c THEN cap.c ELSE annual_inc END AS inc
      FROM loans, cap WHERE target IS NOT NULL),
p AS (SELECT target, MEDIAN(dti) AS dti, MEDIAN(chy) AS chy, MEDIAN(inc) AS inc, AVG(pub_rec) AS pr FROM e GROUP BY target),
w AS (SELECT 'dti' AS feature, 'median' AS statistic, MAX(dti) FILTER (WHERE target = 1) AS dv, MAX(dti) FILTER (WHERE target = 0) AS pv FROM p
      UNION ALL SELECT 'credit_history_years', 'median', MAX(chy) FILTER (WHERE target = 1), MAX(chy) FILTER (WHERE target = 0) FROM p
      UNION ALL SELECT 'annual_inc_capped', 'median', MAX(inc) FILTER (WHERE target = 1), MAX(inc) FILTER (WHERE target = 0) FROM p
      UNION ALL SELECT 'pub_rec', 'mean', MAX(pr) FILTER (WHERE target = 1), MAX(pr) FILTER (WHERE target = 0) FROM p)
SELECT feature, statistic, ROUND(dv, 6) AS default_value, ROUND(pv, 6) AS paid_value, ROUND(dv - pv, 6) AS difference,
       ROUND((dv - pv) / pv * 100, 6) AS pct_difference FROM w"""


@query("hypothesis_summary", oracle=_HYP)
def hypothesis_summary(spark, sf_dir):
    """The five hypotheses' class statistics in one grouped pass."""
    loans = inputs.loans(spark, sf_dir)
    cap = scalar_values(exact_quantiles(loans, "annual_inc", [0.99]).select(F.col("q_0").alias("_cap")))["_cap"]
    e = loans.withColumn("_cap", cap).select(
        "target", "dti", "pub_rec",
        years_until(month_text_to_date("earliest_cr_line")).alias("credit_history_years"),
        clip_keep_null("annual_inc", 0.0, F.col("_cap")).alias("annual_inc_capped"),
    )
    return prof.hypothesis_summary(e)
