"""Registered population-study queries (accepted vs rejected)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import EMP_ORDER, SCORE_BANDS
from ..operators import population as pop
from ..operators import profile as prof
from ..operators.labelling import with_issue_year
from ..sources import fixtures
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

REJ = oracle_views(("rejected",))
BOTH = oracle_views(("raw_loans", "loans", "rejected"))

# The oracle's cleaned rejected table.
REJ_CLEAN = REJ.rstrip() + """,
rej AS (SELECT *, TRY_CAST(TRIM(REPLACE(dti_text, '%', '')) AS DOUBLE) AS dti, YEAR(application_date) AS year,
               COALESCE(emp_length, 'n/a') AS emp_clean FROM rejected)
"""
BOTH_CLEAN = BOTH.rstrip() + """,
rej AS (SELECT *, TRY_CAST(TRIM(REPLACE(dti_text, '%', '')) AS DOUBLE) AS dti, YEAR(application_date) AS year,
               COALESCE(emp_length, 'n/a') AS emp_clean FROM rejected)
"""


def _rej(spark, sf_dir):
    return pop.clean_rejected(inputs.rejected(spark, sf_dir))


@query("rejected_clean", oracle=REJ_CLEAN + "SELECT app_id, amount_requested, risk_score, dti, year, state, emp_clean FROM rej")
def rejected_clean(spark, sf_dir):
    """Percent text, ISO year, 'n/a' fill over the whole rejected table."""
    return _rej(spark, sf_dir).select("app_id", "amount_requested", "risk_score", "dti", "year", "state", "emp_clean")


@query("funnel", oracle=BOTH.rstrip() + """,
c AS (SELECT 'accepted' AS stage, 2 AS step, COUNT(*) AS n FROM raw_loans
      UNION ALL SELECT 'rejected', 1, COUNT(*) FROM rejected
      UNION ALL SELECT 'resolved', 3, COUNT(*) FROM loans),
t AS (SELECT SUM(n) AS a FROM c WHERE stage IN ('accepted', 'rejected')),
u AS (SELECT * FROM c UNION ALL SELECT 'all_applications', 0, a FROM t)
SELECT stage, step, n, n / a AS share_of_all FROM u, t""")
def funnel(spark, sf_dir):
    return pop.funnel(spark, fixtures.raw_loans(spark, sf_dir), inputs.rejected(spark, sf_dir), inputs.loans(spark, sf_dir))


_bands = " UNION ALL ".join(f"SELECT {i} AS band_order, '{n}' AS band, {float(a)}E0 AS band_lo, {float(b)}E0 AS band_hi"
                            for i, (a, b, n) in enumerate(SCORE_BANDS))


@query("score_bands", oracle=REJ.rstrip() + f""",
v AS (SELECT risk_score AS s FROM rejected WHERE risk_score IS NOT NULL AND risk_score >= 300 AND risk_score <= 850),
b AS ({_bands}),
c AS (SELECT b.band_order, COUNT(v.s) AS n FROM b LEFT JOIN v ON v.s >= b.band_lo AND v.s < b.band_hi GROUP BY b.band_order)
SELECT b.band_order, b.band, b.band_lo, b.band_hi, c.n, c.n / (SELECT COUNT(*) FROM v) AS share
FROM b JOIN c ON b.band_order = c.band_order""")
def score_bands(spark, sf_dir):
    return pop.score_bands(inputs.rejected(spark, sf_dir))


_emp = " UNION ALL ".join(f"SELECT {i} AS pos, '{c}' AS category" for i, c in enumerate(EMP_ORDER))


@query("employment_compare", oracle=BOTH_CLEAN.rstrip() + f""",
cats AS ({_emp}),
a AS (SELECT emp_length AS category, COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER () AS p FROM loans WHERE emp_length IS NOT NULL GROUP BY emp_length),
r AS (SELECT emp_clean AS category, COUNT(*) * 100.0E0 / SUM(COUNT(*)) OVER () AS p FROM rej GROUP BY emp_clean)
SELECT cats.pos, cats.category, ROUND(COALESCE(a.p, 0), 1) AS accepted_pct, ROUND(COALESCE(r.p, 0), 1) AS rejected_pct,
       ROUND(COALESCE(r.p, 0) - COALESCE(a.p, 0), 1) AS diff_pct
FROM cats LEFT JOIN a ON cats.category = a.category LEFT JOIN r ON cats.category = r.category""")
def employment_compare(spark, sf_dir):
    """Employment-length shares of both populations on the fixed category order."""
    return pop.compare_shares(inputs.loans(spark, sf_dir), "emp_length", _rej(spark, sf_dir), "emp_clean")


@query("rejected_per_year", oracle=REJ_CLEAN + """
SELECT year, COUNT(*) AS rejected FROM rej WHERE year IS NOT NULL AND year BETWEEN 2007 AND 2018 GROUP BY year""")
def rejected_per_year(spark, sf_dir):
    """The chunked yearly Counter as one partitioned groupBy over all rows."""
    return pop.yearly_counts(_rej(spark, sf_dir), name="rejected")


def _acc_years(spark, sf_dir, first=2007, last=2018):
    acc = with_issue_year(inputs.loans(spark, sf_dir), out="year")
    return pop.yearly_counts(acc, first=first, last=last, name="accepted")


@query("yearly_rejection_rate", oracle=BOTH_CLEAN.rstrip() + """,
r AS (SELECT year, COUNT(*) AS rejected FROM rej WHERE year BETWEEN 2007 AND 2018 GROUP BY year),
a AS (SELECT YEAR(issue_date) AS year, COUNT(*) AS accepted FROM loans WHERE YEAR(issue_date) BETWEEN 2007 AND 2018 GROUP BY 1)
SELECT r.year, rejected, accepted, rejected / (rejected + accepted) AS rejection_rate,
       (rejected - LAG(rejected) OVER (ORDER BY r.year)) / LAG(rejected) OVER (ORDER BY r.year) * 100.0E0 AS rejected_change_pct
FROM r JOIN a ON r.year = a.year""")
def yearly_rejection_rate(spark, sf_dir):
    """J3/W2 (the fixture's accepted years do not overlap 2007-2018, so this is empty there)."""
    return pop.yearly_rejection(pop.yearly_counts(_rej(spark, sf_dir), name="rejected"), _acc_years(spark, sf_dir))


@query("yearly_rejection_overlap", oracle=BOTH_CLEAN.rstrip() + """,
r AS (SELECT year, COUNT(*) AS rejected FROM rej WHERE year BETWEEN 2007 AND 2018 GROUP BY year),
a AS (SELECT YEAR(issue_date) + 16 AS year, COUNT(*) AS accepted FROM loans WHERE YEAR(issue_date) + 16 BETWEEN 2007 AND 2018 GROUP BY 1)
SELECT r.year, rejected, accepted, rejected / (rejected + accepted) AS rejection_rate,
       (rejected - LAG(rejected) OVER (ORDER BY r.year)) / LAG(rejected) OVER (ORDER BY r.year) * 100.0E0 AS rejected_change_pct
FROM r JOIN a ON r.year = a.year""")
def yearly_rejection_overlap(spark, sf_dir):
    """J3/W2 over common years: the fixture's accepted loans are taken as issued 16 years later."""
    later = with_issue_year(inputs.loans(spark, sf_dir), out="year").withColumn("year", F.col("year") + 16)
    return pop.yearly_rejection(pop.yearly_counts(_rej(spark, sf_dir), name="rejected"), pop.yearly_counts(later, name="accepted"))


@query("yearly_counts_both", oracle=BOTH_CLEAN.rstrip() + """,
r AS (SELECT year, COUNT(*) AS rejected FROM rej WHERE year IS NOT NULL GROUP BY year),
a AS (SELECT YEAR(issue_date) AS year, COUNT(*) AS accepted FROM loans WHERE issue_date IS NOT NULL GROUP BY 1)
SELECT COALESCE(r.year, a.year) AS year, COALESCE(rejected, 0) AS rejected, COALESCE(accepted, 0) AS accepted
FROM r FULL OUTER JOIN a ON r.year = a.year""")
def yearly_counts_both(spark, sf_dir):
    """Full outer year alignment of both populations over every year present."""
    return pop.yearly_both(pop.yearly_counts(_rej(spark, sf_dir), first=0, last=9999, name="rejected"),
                           _acc_years(spark, sf_dir, 0, 9999))


@query("state_rejection", oracle=BOTH.rstrip() + f""",
a AS (SELECT addr_state AS state, COUNT(*) AS accepted FROM loans WHERE addr_state IS NOT NULL GROUP BY 1),
r AS (SELECT state, COUNT(*) AS rejected FROM rejected WHERE state IS NOT NULL GROUP BY 1),
t AS (SELECT COALESCE(a.state, r.state) AS state, COALESCE(rejected, 0) AS rejected, COALESCE(accepted, 0) AS accepted,
             COALESCE(rejected, 0) + COALESCE(accepted, 0) AS total FROM a FULL OUTER JOIN r ON a.state = r.state),
f AS (SELECT *, rejected / total AS rej_rate FROM t WHERE total > {inputs.FLOORS["state_rejection"]})
SELECT state, rejected, accepted, total, rej_rate,
       ROW_NUMBER() OVER (ORDER BY rej_rate DESC, state) AS rank_desc,
       ROW_NUMBER() OVER (ORDER BY rej_rate DESC, state) <= 20 AS in_top,
       ROW_NUMBER() OVER (ORDER BY rej_rate ASC, state DESC) <= 20 AS in_bottom,
       ROUND(AVG(rej_rate) OVER (), 9) AS mean_rate,
       CASE WHEN rej_rate > 0.95 THEN 'red' WHEN rej_rate > 0.90 THEN 'orange' ELSE 'blue' END AS tier
FROM f""")
def state_rejection(spark, sf_dir):
    """State table with floor, top/bottom flags and the unweighted mean line."""
    return pop.state_rejection(inputs.loans(spark, sf_dir), "addr_state", inputs.rejected(spark, sf_dir), "state",
                               min_total=inputs.FLOORS["state_rejection"])


@query("dti_populations", oracle=BOTH_CLEAN.rstrip() + """,
a AS (SELECT dti AS x FROM loans WHERE dti IS NOT NULL AND dti >= 0 AND dti <= 100),
r AS (SELECT dti AS x FROM rej WHERE dti IS NOT NULL AND dti >= 0 AND dti <= 100)
SELECT 'accepted' AS population, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(MEDIAN(x), 9) AS median, ROUND(STDDEV_SAMP(x), 6) AS std FROM a
UNION ALL SELECT 'rejected', COUNT(*), ROUND(AVG(x), 6), ROUND(MEDIAN(x), 9), ROUND(STDDEV_SAMP(x), 6) FROM r""")
def dti_populations(spark, sf_dir):
    return pop.population_stats(inputs.loans(spark, sf_dir), "dti", _rej(spark, sf_dir), "dti", 0, 100)


@query("amount_populations", oracle=BOTH.rstrip() + """,
a AS (SELECT loan_amnt AS x FROM loans WHERE loan_amnt IS NOT NULL AND loan_amnt > 0 AND loan_amnt <= 40000),
r AS (SELECT amount_requested AS x FROM rejected WHERE amount_requested IS NOT NULL AND amount_requested > 0 AND amount_requested <= 40000)
SELECT 'accepted' AS population, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(MEDIAN(x), 9) AS median, ROUND(STDDEV_SAMP(x), 6) AS std FROM a
UNION ALL SELECT 'rejected', COUNT(*), ROUND(AVG(x), 6), ROUND(MEDIAN(x), 9), ROUND(STDDEV_SAMP(x), 6) FROM r""")
def amount_populations(spark, sf_dir):
    return pop.population_stats(inputs.loans(spark, sf_dir), "loan_amnt", inputs.rejected(spark, sf_dir), "amount_requested",
                                0, 40000, lo_inclusive=False)


_RISK_HIST = REJ.rstrip() + """,
d AS (SELECT risk_score AS x FROM rejected WHERE risk_score IS NOT NULL AND risk_score >= 300 AND risk_score <= 850),
r AS (SELECT MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, (MAX(x) - MIN(x)) / 80.0E0 AS w FROM d),
c AS (SELECT LEAST(79, CAST(FLOOR((d.x - r.lo) / (r.hi - r.lo) * 80.0E0) AS INT)) AS bin, COUNT(*) AS cnt FROM d, r GROUP BY 1),
b AS (SELECT CAST(range AS INT) AS bin FROM range(80))
SELECT b.bin, r.lo + b.bin * r.w AS bin_lo, r.lo + (b.bin + 1) * r.w AS bin_hi, COALESCE(c.cnt, 0) AS count
FROM b CROSS JOIN r LEFT JOIN c ON b.bin = c.bin"""


@query("risk_score_histogram", oracle=_RISK_HIST)
def risk_score_histogram(spark, sf_dir):
    """A18 with 80 bins over in-range risk scores (counts)."""
    rej = inputs.rejected(spark, sf_dir)
    valid = rej.filter(F.col("risk_score").isNotNull() & (F.col("risk_score") >= 300) & (F.col("risk_score") <= 850))
    return prof.histogram(valid, "risk_score", 80, density=False)


@query("rejected_yearly_change", oracle=REJ_CLEAN.rstrip() + """,
y AS (SELECT year, COUNT(*) AS rejected FROM rej WHERE year IS NOT NULL AND year BETWEEN 2007 AND 2018 GROUP BY year)
SELECT year, rejected, (rejected - LAG(rejected) OVER (ORDER BY year)) / LAG(rejected) OVER (ORDER BY year) * 100.0E0 AS change_pct FROM y""")
def rejected_yearly_change(spark, sf_dir):
    """Year-over-year change of rejected volume (lag over the ≤12-row yearly table)."""
    from pyspark.sql import Window

    y = pop.yearly_counts(_rej(spark, sf_dir), name="rejected")
    w = Window.orderBy("year")
    return y.select("year", "rejected", ((F.col("rejected") - F.lag("rejected").over(w)) / F.lag("rejected").over(w) * 100.0).alias("change_pct"))


def _hist_sql(src: str, bins: int) -> str:
    return f""",
d AS ({src}),
r AS (SELECT population, MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, (MAX(x) - MIN(x)) / {bins}.0E0 AS w FROM d GROUP BY population),
c AS (SELECT d.population, CASE WHEN r.hi = r.lo THEN 0 ELSE LEAST({bins - 1}, CAST(FLOOR((d.x - r.lo) / (r.hi - r.lo) * {bins}.0E0) AS INT)) END AS bin,
             COUNT(*) AS cnt FROM d JOIN r ON d.population = r.population GROUP BY ALL),
b AS (SELECT r.population, g.bin, r.lo, r.w, r.n FROM r, (SELECT CAST(range AS INT) AS bin FROM range({bins})) g)
SELECT b.population, b.bin, b.lo + b.bin * b.w AS bin_lo, b.lo + (b.bin + 1) * b.w AS bin_hi,
       COALESCE(c.cnt, 0) AS count, COALESCE(c.cnt, 0) / (b.n * b.w) AS density
FROM b LEFT JOIN c ON b.population = c.population AND b.bin = c.bin"""


@query("dti_population_histogram", oracle=BOTH_CLEAN.rstrip() + _hist_sql(
    "SELECT 'accepted' AS population, dti AS x FROM loans WHERE dti IS NOT NULL AND dti >= 0 AND dti <= 100 "
    "UNION ALL SELECT 'rejected', dti FROM rej WHERE dti IS NOT NULL AND dti >= 0 AND dti <= 100", 60))
def dti_population_histogram(spark, sf_dir):
    """60-bin density of DTI for both populations (each on its own range)."""
    a = inputs.loans(spark, sf_dir).select(F.lit("accepted").alias("population"), F.col("dti").alias("x"))
    r = _rej(spark, sf_dir).select(F.lit("rejected").alias("population"), F.col("dti").alias("x"))
    both = a.unionByName(r).filter(F.col("x").isNotNull() & (F.col("x") >= 0) & (F.col("x") <= 100))
    return prof.histogram(both, "x", 60, by="population", density=True)


@query("amount_population_histogram", oracle=BOTH.rstrip() + _hist_sql(
    "SELECT 'accepted' AS population, loan_amnt AS x FROM loans WHERE loan_amnt > 0 AND loan_amnt <= 40000 "
    "UNION ALL SELECT 'rejected', amount_requested FROM rejected WHERE amount_requested > 0 AND amount_requested <= 40000", 50))
def amount_population_histogram(spark, sf_dir):
    """50-bin density of requested amounts for both populations."""
    a = inputs.loans(spark, sf_dir).select(F.lit("accepted").alias("population"), F.col("loan_amnt").alias("x"))
    r = inputs.rejected(spark, sf_dir).select(F.lit("rejected").alias("population"), F.col("amount_requested").alias("x"))
    both = a.unionByName(r).filter((F.col("x") > 0) & (F.col("x") <= 40000))
    return prof.histogram(both, "x", 50, by="population", density=True)


@query("year_state_counts_one_scan", oracle=REJ_CLEAN + """
SELECT CASE WHEN GROUPING(year) = 0 THEN 'year' ELSE 'state' END AS level, year, state, COUNT(*) AS n
FROM rej GROUP BY GROUPING SETS ((year), (state))""")
def year_state_counts_one_scan(spark, sf_dir):
    """S4 / plan C: yearly and per-state counts of all rejected rows in one scan (grouping sets)."""
    return pop.year_and_state_counts(_rej(spark, sf_dir))


@query("risk_score_describe", oracle=REJ + """
SELECT 'risk_score' AS column_name, COUNT(risk_score) AS count, ROUND(AVG(risk_score), 6) AS mean, ROUND(STDDEV_SAMP(risk_score), 6) AS std,
       MIN(risk_score) AS min, ROUND(QUANTILE_CONT(risk_score, 0.25), 9) AS p25, ROUND(QUANTILE_CONT(risk_score, 0.5), 9) AS p50,
       ROUND(QUANTILE_CONT(risk_score, 0.75), 9) AS p75, MAX(risk_score) AS max FROM rejected""")
def risk_score_describe(spark, sf_dir):
    """A17 on the rejected side (``describe`` of the risk score, exact quartiles)."""
    d = prof.describe_exact(inputs.rejected(spark, sf_dir), ["risk_score"])
    for c, digits in (("mean", 6), ("std", 6), ("p25", 9), ("p50", 9), ("p75", 9)):
        d = d.withColumn(c, F.round(c, digits))
    return d
