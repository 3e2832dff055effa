"""Segment and trend questions over the labelled loan table.

Each function is the DataFrame form of one of the reference's SQL questions;
group-size floors and top-k sizes are parameters.  All aggregates are
algebraic (count/sum/avg), so Spark combines them map-side before the
shuffle: a hot group (one state or purpose holding a third of the rows)
costs one partial row per task, not a skewed reducer.  Ordering ties are
broken on the group keys so LIMIT is deterministic.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recode import DTI_BOUNDS, DTI_LABELS, INCOME_BOUNDS, INCOME_LABELS, RISK_ELSE, RISK_LABELS, SEGMENT_NAMES, at_least_label, bucket

GRADES = ["A", "B", "C", "D", "E", "F", "G"]


def _pct(c: Column, digits: int = 2) -> Column:
    return F.round(c * F.lit(100.0), digits)


def portfolio_summary(loans: DataFrame) -> DataFrame:
    """Whole-table sanity summary (one row)."""
    return loans.agg(
        F.count(F.lit(1)).alias("total_loans"),
        F.sum("target").alias("total_defaults"),
        _pct(F.avg("target")).alias("default_rate_pct"),
        F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
        F.round(F.avg("annual_inc"), 0).alias("avg_annual_income"),
        F.round(F.avg("int_rate"), 2).alias("avg_interest_rate"),
        F.round(F.avg("dti"), 2).alias("avg_dti"),
    )


def risk_by_grade(loans: DataFrame) -> DataFrame:
    """Q1: default rate, rate and size by grade."""
    return (
        loans.filter(F.col("grade").isNotNull())
        .groupBy("grade")
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            F.sum("target").alias("defaults"),
            _pct(F.avg("target")).alias("default_rate_pct"),
            F.round(F.avg("int_rate"), 2).alias("avg_interest_rate"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
            F.round(F.avg("annual_inc"), 0).alias("avg_annual_income"),
        )
        .orderBy("grade")
    )


def _state_agg(loans: DataFrame, min_count: int) -> DataFrame:
    return (
        loans.filter(F.col("addr_state").isNotNull())
        .groupBy(F.col("addr_state").alias("state"))
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            F.sum("target").alias("defaults"),
            F.avg("target").alias("_rate"),
            F.round(F.sum("loan_amnt") / F.lit(1_000_000.0), 1).alias("total_loan_volume_M"),
        )
        .filter(F.col("total_loans") >= min_count)
        .withColumn("default_rate_pct", _pct(F.col("_rate")))
    )


def states_by_volume(loans: DataFrame, min_count: int = 5000, top: int = 10) -> DataFrame:
    """Q2: largest states by loan count with a group-size floor."""
    return (
        _state_agg(loans, min_count)
        .orderBy(F.col("total_loans").desc(), F.col("state"))
        .limit(top)
        .select("state", "total_loans", "defaults", "default_rate_pct", "total_loan_volume_M")
    )


def states_by_default_rate(loans: DataFrame, min_count: int = 5000, top: int = 10) -> DataFrame:
    """Riskiest states with a group-size floor."""
    return (
        _state_agg(loans, min_count)
        .orderBy(F.col("default_rate_pct").desc(), F.col("state"))
        .limit(top)
        .select("state", "default_rate_pct")
    )


def purpose_risk(loans: DataFrame) -> DataFrame:
    """Q3: purposes ranked by default rate with a HIGH/MEDIUM/LOW label."""
    return (
        loans.filter(F.col("purpose").isNotNull())
        .groupBy("purpose")
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            F.avg("target").alias("_rate"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
        )
        .select(
            "purpose", "total_loans", _pct(F.col("_rate")).alias("default_rate_pct"), "avg_loan_amount",
            at_least_label("_rate", RISK_LABELS, RISK_ELSE).alias("risk_category"),
        )
        .orderBy(F.col("default_rate_pct").desc(), "purpose")
    )


def yearly_trend(loans: DataFrame) -> DataFrame:
    """Q4: volume and default rate per issue year."""
    return (
        loans.filter(F.col("issue_year").isNotNull())
        .groupBy(F.col("issue_year").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            F.sum("target").alias("defaults"),
            _pct(F.avg("target")).alias("default_rate_pct"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
            F.round(F.sum("loan_amnt") / F.lit(1_000_000.0), 1).alias("total_volume_M"),
        )
        .orderBy("year")
    )


def income_brackets(loans: DataFrame) -> DataFrame:
    """Q5: CASE-binned income (null income falls in the top bracket, as in SQL)."""
    return (
        loans.groupBy(bucket("annual_inc", INCOME_BOUNDS, INCOME_LABELS).alias("income_bracket"))
        .agg(
            F.count(F.lit(1)).alias("total_loans"),
            _pct(F.avg("target")).alias("default_rate_pct"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
            F.round(F.avg("dti"), 2).alias("avg_dti"),
        )
        .orderBy("income_bracket")
    )


def running_totals(loans: DataFrame) -> DataFrame:
    """Q6: cumulative loans and volume by year.

    The window runs over the yearly aggregate (one row per year), never over
    loan rows, so its single partition holds a dozen rows at any scale.
    The running volume sums the rounded yearly volumes, as the reference does.
    """
    yearly = (
        loans.filter(F.col("issue_year").isNotNull())
        .groupBy(F.col("issue_year").alias("year"))
        .agg(F.count(F.lit(1)).alias("loans_issued"), F.round(F.sum("loan_amnt") / F.lit(1_000_000.0), 1).alias("volume_M"))
    )
    w = Window.orderBy("year").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return yearly.select(
        "year", "loans_issued", "volume_M",
        F.sum("loans_issued").over(w).alias("running_total_loans"),
        F.round(F.sum("volume_M").over(w), 1).alias("running_volume_M"),
    ).orderBy("year")


def default_segments() -> dict[str, Column | None]:
    """Q7 segments: name -> predicate (``None`` = every row)."""
    return {
        SEGMENT_NAMES[0]: F.col("grade").isin("D", "E", "F", "G") & (F.col("dti") > 25),
        SEGMENT_NAMES[1]: F.col("grade").isin("A", "B") & (F.col("dti") <= 20),
        SEGMENT_NAMES[2]: None,
    }


def default_segments_names() -> list[str]:
    return list(SEGMENT_NAMES)


def segment_profile(loans: DataFrame, segments: Mapping[str, Column | None] | None = None) -> DataFrame:
    """Q7 in one scan: each row is exploded into the segments it matches, then one groupBy.

    Equivalent to a UNION ALL of one aggregate per segment, but reads the
    table once.  The all-rows segment is a hot key by construction; partial
    aggregation collapses it per task before the shuffle.
    """
    segments = dict(segments or default_segments())
    names = [F.when(pred, F.lit(name)) if pred is not None else F.lit(name) for name, pred in segments.items()]
    tagged = loans.select(
        F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("segment"),
        "target", "loan_amnt", "annual_inc", "int_rate", "dti",
    )
    return tagged.groupBy("segment").agg(
        F.count(F.lit(1)).alias("loan_count"),
        _pct(F.avg("target")).alias("default_rate_pct"),
        F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
        F.round(F.avg("annual_inc"), 0).alias("avg_annual_income"),
        F.round(F.avg("int_rate"), 2).alias("avg_interest_rate"),
        F.round(F.avg("dti"), 2).alias("avg_dti"),
    )


def segment_union(loans: DataFrame, segments: Mapping[str, Column | None] | None = None) -> DataFrame:
    """Q7 literally: one aggregate per segment, ``unionByName``."""
    segments = dict(segments or default_segments())
    parts = []
    for name, pred in segments.items():
        src = loans if pred is None else loans.filter(pred)
        parts.append(src.agg(
            F.lit(name).alias("segment"),
            F.count(F.lit(1)).alias("loan_count"),
            _pct(F.avg("target")).alias("default_rate_pct"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
            F.round(F.avg("annual_inc"), 0).alias("avg_annual_income"),
            F.round(F.avg("int_rate"), 2).alias("avg_interest_rate"),
            F.round(F.avg("dti"), 2).alias("avg_dti"),
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dti_buckets(loans: DataFrame, min_count: int = 1000) -> DataFrame:
    """Q8: DTI bins over non-negative DTI with a group-size floor."""
    return (
        loans.filter(F.col("dti").isNotNull() & (F.col("dti") >= 0))
        .groupBy(bucket("dti", DTI_BOUNDS, DTI_LABELS).alias("dti_bucket"))
        .agg(
            F.count(F.lit(1)).alias("loan_count"),
            _pct(F.avg("target")).alias("default_rate_pct"),
            F.round(F.avg("annual_inc"), 0).alias("avg_income"),
            F.round(F.avg("loan_amnt"), 0).alias("avg_loan_amount"),
        )
        .filter(F.col("loan_count") >= min_count)
        .orderBy("dti_bucket")
    )


def _grade_purpose(loans: DataFrame, min_count: int) -> DataFrame:
    # No null filter: null grade / purpose form their own groups, as SQL GROUP BY does.
    return (
        loans.groupBy("grade", "purpose")
        .agg(F.count(F.lit(1)).alias("loan_count"), F.avg("target").alias("_rate"))
        .filter(F.col("loan_count") >= min_count)
        .withColumn("default_rate_pct", _pct(F.col("_rate"), 1))
    )


def grade_purpose_top(loans: DataFrame, min_count: int = 500, top: int = 15) -> DataFrame:
    """Q9: riskiest grade x purpose cells with a floor."""
    return (
        _grade_purpose(loans, min_count)
        .orderBy(F.col("default_rate_pct").desc(), F.col("loan_count").desc(),
                 F.col("grade").asc_nulls_first(), F.col("purpose").asc_nulls_first())
        .limit(top)
        .select("grade", "purpose", "loan_count", "default_rate_pct")
    )


def grade_purpose_matrix(loans: DataFrame, min_count: int = 500, grades: Sequence[str] = GRADES) -> DataFrame:
    """Q9 heat-map table: purpose rows, one column per grade (explicit pivot values, no distinct job)."""
    cells = _grade_purpose(loans, min_count).filter(F.col("purpose").isNotNull())
    return cells.groupBy("purpose").pivot("grade", list(grades)).agg(F.first("default_rate_pct"))


def run_sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text over DataFrames passed by name (``{loans}`` in the text)."""
    return spark.sql(text, **tables)
