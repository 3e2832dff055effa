"""Registered source queries: a CSV written from the rejected table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

REJ = oracle_views(("rejected",))
_SCHEMA = "app_id long, amount_requested double, application_date string, risk_score double, dti_text string, state string, emp_length string"
_NAMES = [part.split()[0] for part in _SCHEMA.split(", ")]


def _read(spark, sf_dir):
    """The rejected table as CSV lines, read back; every fiftieth line lacks its last two fields."""
    rows = inputs.rejected(spark, sf_dir).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in _NAMES])
    whole, cut = F.concat_ws(",", *_NAMES), F.concat_ws(",", *_NAMES[:-2])
    path = scratch_path(spark, "rejected_csv")
    rows.select(F.when(F.col("app_id").cast("long") % 50 == 0, cut).otherwise(whole).alias("value")).write.text(path)
    return files.read_csv_checked(spark, path, _SCHEMA, header=False)


@query("rejected_csv", oracle=REJ + """
SELECT app_id, amount_requested, CAST(application_date AS VARCHAR) AS application_date, risk_score,
       NULLIF(dti_text, 'n/a') AS dti_text, state, emp_length FROM rejected WHERE app_id % 50 <> 0""")
def rejected_csv(spark, sf_dir):
    """Typed rows of the CSV, missing words as nulls."""
    return _read(spark, sf_dir)[0]


@query("rejected_csv_quarantine", oracle=REJ + """
SELECT 'kept' AS part, COUNT(*) AS lines FROM rejected WHERE app_id % 50 <> 0 UNION ALL SELECT 'quarantined', COUNT(*) FROM rejected WHERE app_id % 50 = 0""")
def rejected_csv_quarantine(spark, sf_dir):
    """Lines kept and lines set aside; together all lines of the source."""
    good, bad = _read(spark, sf_dir)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("lines")).select(F.lit(name).alias("part"), "lines")
    return count(good, "kept").unionByName(count(bad, "quarantined"))
