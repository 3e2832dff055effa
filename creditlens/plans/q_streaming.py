"""Registered streaming query: the chunked yearly Counter as a file stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import counts
from . import inputs
from .q_population import REJ_CLEAN
from .registry import query


@query("rejected_per_year_stream", oracle=REJ_CLEAN + """
SELECT year, COUNT(*) AS rejected FROM rej WHERE year IS NOT NULL AND year BETWEEN 2007 AND 2018 GROUP BY year""")
def rejected_per_year_stream(spark, sf_dir):
    """S4 streaming: the rejected table's files read as a stream (one file per
    micro-batch), running per-year state, complete output, drained with availableNow."""
    rej = inputs.rejected(spark, sf_dir)
    folder = inputs._WRITTEN[(spark.sparkContext.applicationId, sf_dir, "rejected")]
    stream = counts.yearly_counts_stream(spark, folder, rej.schema)
    table = counts.run_to_table(stream, f"rejected_years_{uuid.uuid4().hex[:8]}")
    return table.filter((F.col("year") >= 2007) & (F.col("year") <= 2018)).select("year", F.col("n").alias("rejected"))
