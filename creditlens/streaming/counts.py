"""Streaming forms of the counting and scoring jobs.

The reference counts a growing application file in 1M-row chunks with a
running Counter.  The Structured Streaming equivalent reads the file folder
incrementally (``maxFilesPerTrigger`` bounds each micro-batch), keeps the
per-year / per-state counts as streaming state, and emits the complete
table into Parquet versions; ``trigger(availableNow=True)`` drains what is there
and stops.  The checkpoint location lives under the shared ``spark.checkpoint.dir`` so a
restarted query resumes exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.recode import iso_date
from ..functions.scalars import scalar_values
from ..session import scratch_path


def yearly_counts_stream(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet",
                         date_col: str = "application_date", max_files: int = 1) -> DataFrame:
    """Streaming DataFrame of running counts per application year."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(folder)
    year = F.year(iso_date(F.col(date_col).cast("string")))
    return src.select(year.alias("year")).filter(F.col("year").isNotNull()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def run_to_table(stream: DataFrame, name: str, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Drain the available input (availableNow) into a versioned Parquet table and return it.

    Each micro-batch writes one version, the sub-folder of its batch id: a batch that is run
    again after a failure overwrites its own version, so every row counts once. ``folder``
    holds the table and the stream's log; given again, the stream goes on where it stopped.
    In ``complete`` mode the result is the last version, in ``append`` mode all of them."""
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, f"stream-{name}")
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    q = (stream.writeStream.outputMode(mode).queryName(name).foreachBatch(lambda batch, i: save_version(batch, i, f"{folder}/table"))
         .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start())
    q.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/table/batch_id=-1")  # a table without versions is empty
    table = spark.read.schema(schema).parquet(f"{folder}/table")
    if mode == "complete":
        last = scalar_values(table.agg(F.max("batch_id").alias("last")))["last"]
        table = table.filter(F.col("batch_id") == last)
    return table.drop("batch_id")


def save_version(batch: DataFrame, batch_id: int, table: str) -> None:
    batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")


def score_stream(spark: SparkSession, model, folder: str, schema: StructType | str, features: list[str],
                 fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    """M6 on a stream: new rows are assembled and scored as they arrive."""
    from ..operators.models import assemble, score

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(folder)
    return score(model, assemble(src, features))
