"""Datasets derived from the driver's tables that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.labelling import label_target, sql_table
from ..sources import fixtures

#: Group-size floors of the registered queries, the same for every table: chosen so that sf0.01
#: keeps some groups and drops others. The operators' defaults are the reference's values.
FLOORS = {"state": 500, "dti": 1550, "grade_purpose": 50, "state_rejection": 900}


_WRITTEN: dict = {}


def materialise(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Write a derived table once per session to the shared checkpoint folder and
    read it back: later queries scan plain Parquet (pruned, pushed down) instead
    of re-deriving it, and the lineage is cut (a lost executor re-reads files)."""
    from ..session import scratch_path

    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted loans, status-filtered and labelled (reference ``loans_filtered``),
    written once as Parquet like the reference's intermediate file.

    The raw table is written first: the filter would be pushed into the expressions that
    make its columns, and one generated method for all of them is too long to be compiled."""
    raw = materialise(spark, sf_dir, "raw_loans", lambda: fixtures.raw_loans(spark, sf_dir))
    return materialise(spark, sf_dir, "loans_filtered", lambda: label_target(raw))


def loans_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 17-column SQL table (``issue_year`` parsed from the month text)."""
    return sql_table(loans(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str, alt: bool = False) -> DataFrame:
    """Deterministic score table (FIXTURES §B4) for the evaluation operators."""
    text = fixtures.SCORED_ALT_SQL if alt else fixtures.SCORED_SQL
    return materialise(spark, sf_dir, "scored_alt" if alt else "scored",
                       lambda: spark.sql(text, loans=fixtures.spark_loans_with_dates(spark, sf_dir)))


def rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(spark, sf_dir, "rejected", lambda: fixtures.rejected_raw(spark, sf_dir))
