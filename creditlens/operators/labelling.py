"""Load-filter-label: status filter that keeps nulls, status -> target recode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import DROP_STATUSES, STATUS_TARGET, exclude_keep_null, month_text_to_date, recode

# Columns of the reference's SQL table ``loans`` (plus the derived issue year).
SQL_COLUMNS = [
    "loan_amnt", "int_rate", "grade", "emp_length", "home_ownership", "annual_inc", "purpose", "addr_state",
    "dti", "open_acc", "revol_bal", "revol_util", "mort_acc", "delinq_2yrs", "inq_last_6mths", "target",
]


def label_target(
    df: DataFrame,
    status_col: str = "loan_status",
    drop: Sequence[str] = DROP_STATUSES,
    mapping: Mapping[str, int] = STATUS_TARGET,
    target: str = "target",
) -> DataFrame:
    """Drop ambiguous statuses (null statuses stay) and add a nullable double target."""
    return df.filter(exclude_keep_null(status_col, drop)).withColumn(target, recode(status_col, mapping).cast("double"))


def with_issue_year(df: DataFrame, month_col: str = "issue_d", out: str = "issue_year") -> DataFrame:
    """Issue year from ``MMM-yyyy`` text; bad text gives a null year."""
    return df.withColumn(out, F.year(month_text_to_date(month_col)))


def sql_table(labelled: DataFrame) -> DataFrame:
    """The 17-column table the SQL questions run on (pruned: the scan reads only these)."""
    return with_issue_year(labelled).select(*SQL_COLUMNS, "issue_year")
