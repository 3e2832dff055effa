"""CSV / Parquet sources and sinks for the raw loan and application files.

The reference reads 151-column CSVs with pandas (inferred types, a fixed set
of words read as missing), optionally only some columns, optionally only the
head of the file.  Here: an explicit schema (no inference pass), pruning by
``select``, the pandas missing-value words normalised after the read, and
sampling as a seeded fraction — never a head, which biases toward early rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.recode import null_words_to_null
from ..session import written

# Raw column names of the rejected-applications file and our names for them.
REJECTED_COLUMNS = {
    "Amount Requested": "amount_requested",
    "Application Date": "application_date",
    "Risk_Score": "risk_score",
    "Debt-To-Income Ratio": "dti_text",
    "State": "state",
    "Employment Length": "emp_length",
}


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             columns: Sequence[str] | None = None, null_words: bool = True, multi_line: bool = False) -> DataFrame:
    """Header CSV; typed by ``schema`` when given (text otherwise), pruned to
    ``columns``, pandas' missing words -> null.  ``multi_line`` reads quoted fields
    that hold line breaks, at the cost of one task per file: such a file cannot be split."""
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "PERMISSIVE")
    if schema is not None:
        # Read text first so that words like 'n/a' in numeric columns become null, not parse errors.
        st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        df = reader.schema(StructType([f.__class__(f.name, StringType(), True) for f in st.fields])).csv(path)
        if columns:
            df = df.select(*[f"`{c}`" for c in columns])
        cols = []
        for f in st.fields:
            if columns and f.name not in columns:
                continue
            c = null_words_to_null(F.col(f"`{f.name}`")) if null_words else F.col(f"`{f.name}`")
            cols.append(c.try_cast(f.dataType).alias(f.name) if f.dataType != StringType() else c.alias(f.name))
        return df.select(*cols)
    df = reader.csv(path)
    if columns:
        df = df.select(*[f"`{c}`" for c in columns])
    if null_words:
        df = df.select(*[null_words_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV that have the fields of ``schema``, typed and with missing words as nulls, and a
    quarantine of the other lines (``line``): every data line is in one of the two. The parsed
    lines are written once to the shared folder, so both are plain scans and files are split."""
    st = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    text = StructType([StructField(f.name, StringType()) for f in st.fields] + [StructField("_line", StringType())])
    reader = spark.read.option("header", header).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
    rows = written(reader.schema(text).csv(path), "csv_rows")
    typed = [null_words_to_null(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) for f in st.fields]
    return rows.where("_line IS NULL").select(*typed), rows.where("_line IS NOT NULL").select(F.col("_line").alias("line"))


def read_rejected_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rejected file's six used columns, renamed to snake case."""
    schema = ("`Amount Requested` double, `Application Date` string, Risk_Score double, "
              "`Debt-To-Income Ratio` string, State string, `Employment Length` string")
    df = read_csv(spark, path, schema=schema, columns=list(REJECTED_COLUMNS))
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in REJECTED_COLUMNS.items()])


def sample_rows(df: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """A seeded Bernoulli sample (every partition contributes); ``None`` keeps all rows."""
    return df if fraction is None else df.sample(withReplacement=False, fraction=fraction, seed=seed)


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """The reference's ``nrows=`` head read (offered for parity; biased to early rows)."""
    return df.limit(n)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet sink (the reference's ``to_parquet(index=False)``)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def register_table(df: DataFrame, name: str) -> DataFrame:
    """The reference's ``to_sql('loans', ...)``: a temp view for ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df
