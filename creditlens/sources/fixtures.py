"""Loan-shaped views over the driver's TPC-H-style tables.

The reference reads a loan CSV that is not shipped; FIXTURES.md binds its
schema onto ``orders``/``customer``/``nation``/``events`` with portable SQL that
both Spark and DuckDB evaluate identically.  The same SQL text builds the
Spark views (tables passed as DataFrame parameters, so no global temp views
are touched) and is repeated as CTEs by the DuckDB oracle.

The raw loan view carries real dates; the text forms the reference parses
(``issue_d``, ``earliest_cr_line`` as ``MMM-yyyy``) are produced here and
parsed back by the operators under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed binding text (FIXTURES.md §B1, §B3, §B4).  Table names are
# placeholders so the text serves both engines.
RAW_LOANS_SQL = """
WITH b AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS ck, o.o_orderstatus AS st, o.o_totalprice AS tp,
         CAST(o.o_orderdate AS DATE) AS od, c.c_acctbal AS bal, c.c_mktsegment AS seg, n.n_name AS nm,
         CAST(SUBSTR(o.o_orderpriority, 1, 1) AS INT) + CASE WHEN o.o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS g,
         (o.o_orderkey * 7919 + 104729) % 1000 AS u,
         (o.o_orderkey * 31 + o.o_custkey * 17) % 4200 AS dk
  FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey)
SELECT k AS id,
  CASE WHEN k % 509 = 0 THEN NULL WHEN st = 'P' AND k % 3 = 0 THEN 'Current'
       WHEN k % 337 = 0 THEN 'Default' WHEN k % 331 = 0 THEN 'In Grace Period'
       WHEN k % 127 = 0 THEN 'Late (31-120 days)'
       WHEN u < 60 + 45 * g + dk / 40 AND k % 41 = 0 THEN 'Does not meet the credit policy. Status:Charged Off'
       WHEN u < 60 + 45 * g + dk / 40 THEN 'Charged Off'
       WHEN k % 43 = 0 THEN 'Does not meet the credit policy. Status:Fully Paid'
       ELSE 'Fully Paid' END AS loan_status,
  ROUND(tp / 12.5) AS loan_amnt,
  4.0E0 + 3.1E0 * g + (k % 97) / 50.0E0 AS int_rate,
  FLOOR(ROUND(tp / 12.5) * (1 + (4.0E0 + 3.1E0 * g) / 100) / 36 * 100) / 100.0E0 AS installment,
  CASE WHEN k % 211 = 0 THEN NULL ELSE SUBSTR('ABCDEFG', g, 1) END AS grade,
  CASE WHEN ck % 13 = 12 THEN NULL WHEN ck % 13 = 0 THEN '< 1 year' WHEN ck % 13 = 1 THEN '1 year'
       WHEN ck % 13 >= 10 THEN '10+ years' ELSE CONCAT(CAST(ck % 13 AS VARCHAR(2)), ' years') END AS emp_length,
  CASE WHEN ck % 10 < 4 THEN 'MORTGAGE' WHEN ck % 10 < 8 THEN 'RENT' WHEN ck % 10 < 9 THEN 'OWN' ELSE 'ANY' END AS home_ownership,
  CASE WHEN ck % 3 = 0 THEN 'Not Verified' WHEN ck % 3 = 1 THEN 'Source Verified' ELSE 'Verified' END AS verification_status,
  CASE WHEN ck % 41 = 0 THEN NULL ELSE ROUND((bal + 1000) * 18) END AS annual_inc,
  CASE WHEN k % 29 = 0 THEN 'small_business' WHEN k % 31 = 0 THEN 'wedding' WHEN k % 499 = 0 THEN NULL ELSE LOWER(seg) END AS purpose,
  nm AS addr_state,
  CASE WHEN k % 97 = 0 THEN NULL ELSE dk / 100.0E0 - 0.5E0 END AS dti,
  CASE WHEN ck % 53 = 0 THEN NULL WHEN ck % 6 = 0 THEN 1 + ck % 4 ELSE 0 END AS pub_rec,
  3 + ck % 20 AS open_acc, 7 + ck % 20 + ck % 23 AS total_acc,
  ABS(bal) * 3 AS revol_bal,
  CASE WHEN ck % 59 = 0 THEN NULL ELSE (ck * 13 % 1000) / 10.0E0 END AS revol_util,
  CASE WHEN k % 20 = 0 THEN NULL ELSE ck % 5 END AS mort_acc,
  CASE WHEN ck % 9 = 0 THEN 1 ELSE 0 END AS delinq_2yrs, k % 4 AS inq_last_6mths,
  od AS issue_date,
  CAST(DATE_TRUNC('month', od - CAST(365 * (2 + ck % 25) AS INT)) AS DATE) AS earliest_cr_date
FROM b
"""

LOANS_SQL = """
SELECT *, CASE WHEN loan_status IN ('Fully Paid','Does not meet the credit policy. Status:Fully Paid') THEN 0E0
               WHEN loan_status IN ('Charged Off','Does not meet the credit policy. Status:Charged Off') THEN 1E0 END AS target
FROM {raw_loans}
WHERE loan_status IS NULL OR loan_status NOT IN
  ('Current','Late (31-120 days)','Late (16-30 days)','In Grace Period','Default')
"""

REJECTED_SQL = """
SELECT e.event_id AS app_id, ROUND(e.value * 100) AS amount_requested,
  DATE '2007-01-01' + CAST((e.event_id * 37) % 4383 AS INT) AS application_date,
  CASE WHEN e.event_id % 13 = 0 THEN NULL ELSE 280E0 + (e.event_id * 53) % 600 END AS risk_score,
  CASE WHEN e.event_id % 101 = 0 THEN 'n/a' WHEN e.event_id % 17 = 0 THEN '-1%'
       ELSE CONCAT(CAST((e.event_id * 29) % 110 AS VARCHAR(4)), '.', CAST(e.event_id % 10 AS VARCHAR(1)), '%') END AS dti_text,
  CASE WHEN e.event_id % 307 = 0 THEN NULL ELSE n.n_name END AS state,
  CASE WHEN e.event_id % 10 < 6 THEN '< 1 year' WHEN e.event_id % 10 = 6 THEN '1 year' WHEN e.event_id % 10 = 7 THEN '5 years'
       WHEN e.event_id % 10 = 8 THEN '10+ years' ELSE NULL END AS emp_length
FROM {events} e JOIN {nation} n ON n.n_nationkey = e.user_id % 25
"""

SCORED_SQL = """
SELECT id, target, (30 + 90 * g + (id * 613) % 300) / 1000.0E0 AS score
FROM (SELECT id, target, CAST(FLOOR((int_rate - 4.0E0) / 3.1E0) AS INT) AS g FROM {loans} WHERE target IS NOT NULL) t
"""

# A second deterministic score (different tie structure) for model-comparison operators.
SCORED_ALT_SQL = """
SELECT id, target, (100 + 70 * g + (id * 389) % 500) / 1000.0E0 AS score
FROM (SELECT id, target, CAST(FLOOR((int_rate - 4.0E0) / 3.1E0) AS INT) AS g FROM {loans} WHERE target IS NOT NULL) t
"""


def raw_loans_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §B1 with real date columns (what the oracle sees)."""
    return spark.sql(
        RAW_LOANS_SQL,
        orders=read_table(spark, sf_dir, "orders"),
        customer=read_table(spark, sf_dir, "customer"),
        nation=read_table(spark, sf_dir, "nation"),
    )


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted-loan table as the reference reads it: month text columns."""
    df = raw_loans_dates(spark, sf_dir)
    return (
        df.withColumn("id", F.col("id").cast("string"))
        .withColumn("issue_d", F.date_format("issue_date", "MMM-yyyy"))
        .withColumn("earliest_cr_line", F.date_format("earliest_cr_date", "MMM-yyyy"))
        .drop("issue_date", "earliest_cr_date")
    )


def rejected_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §B3: the rejected-applications table (text DTI, ISO dates)."""
    df = spark.sql(REJECTED_SQL, events=read_table(spark, sf_dir, "events"), nation=read_table(spark, sf_dir, "nation"))
    return df.withColumn("application_date", F.date_format("application_date", "yyyy-MM-dd"))


def oracle_views(include: tuple[str, ...] = ("raw_loans", "loans")) -> str:
    """CTE prefix for DuckDB: the same binding text over the pre-registered tables."""
    parts = []
    if "raw_loans" in include or "loans" in include or "scored" in include:
        parts.append("raw_loans AS (" + RAW_LOANS_SQL.format(orders="orders", customer="customer", nation="nation") + ")")
    if "loans" in include or "scored" in include:
        parts.append("loans AS (" + LOANS_SQL.format(raw_loans="raw_loans") + ")")
    if "scored" in include:
        parts.append("scored AS (" + SCORED_SQL.format(loans="loans") + ")")
    if "scored_alt" in include:
        parts.append("scored_alt AS (" + SCORED_ALT_SQL.format(loans="loans") + ")")
    if "rejected" in include:
        parts.append("rejected AS (" + REJECTED_SQL.format(events="events", nation="nation") + ")")
    return "WITH " + ",\n".join(parts) + "\n"


def spark_loans_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §B2 in Spark (used only to derive the fixed score table)."""
    return spark.sql(LOANS_SQL, raw_loans=raw_loans_dates(spark, sf_dir))
