"""Profiling operators: audits, frequencies, exact descriptive statistics,
histograms, kernel density curves, box summaries.

Many-column statistics are computed in ONE aggregate and then unpivoted, so
the table is scanned once.  Quantiles are exact (linear interpolation, as
pandas/numpy) and computed by the bucketed rank job of ``prefix`` (values
collapse to counts per task; ranks from range-partitioned running sums), so
no group's value->count map is ever merged in one task.  Pass ``accuracy=``
to switch to ``percentile_approx``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, NumericType, StructField, StructType

from ..functions.recode import EMP_LENGTH_YEARS, GRADE_ORDINAL, HISTORY_END_DATE, clip_keep_null, month_text_to_date, positive_flag, recode, years_until
from ..functions.scalars import scalar_values, with_series_stats
from .prefix import column_quantiles, exact_quantiles, medians


def quantile_expr(col: str | Column, p: float | Sequence[float], accuracy: int | None = None) -> Column:
    """Quantile aggregate expression: ``percentile_approx`` with ``accuracy``, else
    Spark's exact ``percentile`` (for columns with few distinct values)."""
    c = F.col(col) if isinstance(col, str) else col
    if accuracy is not None:
        return F.percentile_approx(c, p if isinstance(p, float) else list(p), accuracy)
    return F.percentile(c, F.lit(p) if isinstance(p, float) else F.array(*[F.lit(x) for x in p]))


def _stack(one_row: DataFrame, names: Sequence[str], fields: Sequence[str], key: str = "column_name", ids: Sequence[str] = ()) -> DataFrame:
    """Turn ``<name>__<field>`` columns of an aggregate into one row per name."""
    structs = [
        F.struct(F.lit(n).alias(key), *[F.col(f"{n}__{f}").alias(f) for f in fields])
        for n in names
    ]
    return one_row.select(*ids, F.explode(F.array(*structs)).alias("_s")).select(*ids, "_s.*")


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows and missing values per column in one pass: (column_name, null_count, row_count)."""
    cols = list(cols or df.columns)
    agg = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}__null_count") for c in cols],
    )
    return _stack(agg.select("*", *[F.col("_n").alias(f"{c}__row_count") for c in cols]), cols, ["null_count", "row_count"])


def frequency(df: DataFrame, col: str, value_name: str | None = None) -> DataFrame:
    """``value_counts`` with counts and shares; nulls are skipped as pandas does.

    The total comes from a one-row aggregate joined back (one row, broadcast)."""
    value_name = value_name or col
    nonnull = df.filter(F.col(col).isNotNull())
    counts = nonnull.groupBy(F.col(col).alias(value_name)).agg(F.count(F.lit(1)).alias("n"))
    total = scalar_values(nonnull.agg(F.count(F.lit(1)).alias("_total")))["_total"]
    return counts.select(value_name, "n", (F.col("n") / total).alias("share"))


def group_stats(df: DataFrame, by: str, col: str, stats: Sequence[str] = ("count", "mean", "median")) -> DataFrame:
    """Per-class mean / count / exact median of one column (null keys skipped)."""
    exprs = {
        "count": F.count(col).alias(f"{col}_count"),
        "mean": F.avg(col).alias(f"{col}_mean"),
    }
    d = df.filter(F.col(by).isNotNull())
    out = d.groupBy(by).agg(*[exprs[s] for s in stats if s != "median"], F.count(F.lit(1)).alias("_rows"))
    if "median" in stats:
        med = medians(d, [col], [by]).withColumnRenamed(col, f"{col}_median")
        out = out.join(med, by, "left")
    return out.select(by, *[f"{col}_{s}" for s in stats])


def first_groups(df: DataFrame, key: str, value: str, n: int = 8) -> DataFrame:
    """``groupby(key)[value].mean().head(n)``: the n smallest non-null keys."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(value).alias(f"{value}_mean"))
        .orderBy(key)
        .limit(n)
    )


def crosstab_counts(df: DataFrame, row: str, col: str, col_values: Sequence | None = None) -> DataFrame:
    """Contingency counts, wide: one column per level of ``col`` (rows with a null in either are skipped)."""
    base = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    g = base.groupBy(row)
    return (g.pivot(col, list(col_values)) if col_values is not None else g.pivot(col)).agg(F.count(F.lit(1))).na.fill(0)


def describe_exact(df: DataFrame, cols: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column — one scan, one row per column."""
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).alias(f"{c}__count"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
            F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        ]
        if accuracy:
            aggs.append(quantile_expr(c, [0.25, 0.5, 0.75], accuracy).alias(f"{c}__q"))
    one = df.agg(*aggs)
    if accuracy:
        one = one.select("*", *[F.col(f"{c}__q")[i].alias(f"{c}__{n}") for c in cols for i, n in enumerate(("p25", "p50", "p75"))])
        return _stack(one, cols, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"])
    # Exact quartiles of every column in one bucketed job, joined on the column name (<= #columns rows).
    base = _stack(one, cols, ["count", "mean", "std", "min", "max"])
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], feature="column_name").select(
        "column_name", F.col("q_0").alias("p25"), F.col("q_1").alias("p50"), F.col("q_2").alias("p75"))
    return base.join(F.broadcast(q), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def histogram(
    df: DataFrame,
    col: str,
    bins: int,
    by: str | None = None,
    density: bool = True,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Equal-width histogram per series (numpy semantics: last bin closed, all bins listed).

    Range per series is its own min/max unless ``lo``/``hi`` are given; values outside a
    given range count neither in the bins nor in the density.  One
    aggregate for the ranges (one row per series, broadcast), one for counts.
    """
    keys = [by] if by else []
    data = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_x"))
    if by:
        data = data.filter(F.col(by).isNotNull())
    if lo is not None or hi is not None:
        data = data.filter((F.col("_x") >= F.lit(lo if lo is not None else -math.inf)) & (F.col("_x") <= F.lit(hi if hi is not None else math.inf)))
    rng = data.groupBy(*keys).agg(
        (F.lit(lo) if lo is not None else F.min("_x")).alias("_lo"),
        (F.lit(hi) if hi is not None else F.max("_x")).alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
    )
    # A constant column gets a range of 0.5 to either side.
    same = F.col("_lo") == F.col("_hi")
    rng = rng.withColumn("_wide", F.when(same, 0.5).otherwise(0.0)).withColumn("_lo", F.col("_lo") - F.col("_wide")).withColumn("_hi", F.col("_hi") + F.col("_wide")).drop("_wide")
    rng = rng.withColumn("_width", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins)))
    joined = with_series_stats(data, rng, keys)
    idx = F.least(
        F.lit(bins - 1),
        F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))).cast("int"),
    )
    counts = joined.groupBy(*keys, idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = rng.select(*keys, "_lo", "_width", "_n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = all_bins.join(counts, keys + ["bin"], "left").select(
        *keys,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_lo"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_width")).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        "_n",
        "_width",
    )
    if density:
        out = out.withColumn("density", F.col("count") / (F.col("_n") * F.col("_width")))
    return out.drop("_n", "_width")


#: Distinct values whose kernels a task holds at once.
KDE_ROWS = 1024


def kde(df: DataFrame, col: str, by: str | None = None, points: int = 1000, digits: int = 10) -> DataFrame:
    """Gaussian KDE on a grid per series (Scott bandwidth = n^(-1/5) * sample std;
    grid from min - range/2 to max + range/2).

    Rows are first collapsed to distinct (value, weight); each task then keeps one
    grid of ``points`` sums per series over its Arrow batches, and a groupBy adds
    the grids — the shuffle carries at most ``points`` rows per series per task.
    The density of a constant series is null.
    """
    keys = [by] if by else []
    data = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_x"))
    if by:
        data = data.filter(F.col(by).isNotNull())
    stats = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx")
    ).select(
        *keys, "_n",
        (F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("_h"),
        (F.col("_mn") - F.lit(0.5) * (F.col("_mx") - F.col("_mn"))).alias("_g0"),
        ((F.lit(2.0) * (F.col("_mx") - F.col("_mn"))) / F.lit(float(points - 1))).alias("_step"),
    )
    distinct = data.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_w"))
    joined = with_series_stats(distinct, stats, keys)
    name = keys[0] if keys else None
    series = joined.select(F.col(name) if by else F.lit(0).alias("_series"), "_x", F.col("_w").cast("double").alias("_w"), "_g0", "_step", "_h")
    label = series.schema[0]

    def partial(batches):
        sums, places, kind = {}, np.arange(points, dtype=np.float64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            rows = batch.to_pandas()
            for key, part in rows.groupby(label.name, sort=False):
                at = part["_g0"].iloc[0] + places * part["_step"].iloc[0]
                total = sums.setdefault(key, np.zeros(points))
                for lo in range(0, len(part), KDE_ROWS):
                    x, w = part["_x"].to_numpy()[lo : lo + KDE_ROWS], part["_w"].to_numpy()[lo : lo + KDE_ROWS]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        total += w @ np.exp(-0.5 * ((at[None, :] - x[:, None]) / part["_h"].iloc[0]) ** 2)
        for key, total in sums.items():
            own = pa.array([key] * points, kind)
            yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(points, dtype=np.int32)), pa.array(total)], [label.name, "point", "_k"])

    contrib = series.mapInArrow(partial, StructType([label, StructField("point", IntegerType()), StructField("_k", DoubleType())]))
    summed = contrib.groupBy(*keys, "point").agg(F.sum("_k").alias("_s"))
    # Every grid point of a series is reported (0 where no value reaches it).
    grid = stats.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    full = grid.join(summed, keys + ["point"], "left").select(*keys, "point", F.coalesce("_s", F.lit(0.0)).alias("_s"))
    return with_series_stats(full, stats, keys).select(
        *keys,
        "point",
        (F.col("_g0") + F.col("point").cast("double") * F.col("_step")).alias("x"),
        F.round(F.try_divide(F.col("_s"), F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi))), digits).alias("density"),
    )


def box_stats(df: DataFrame, col: str, by: str | None = None, whisker: float = 1.5) -> DataFrame:
    """Box-plot summary: exact quartiles, whiskers at the furthest points within
    ``whisker`` x IQR, and the outlier count.  Two aggregates; the quartile row
    per series is broadcast back."""
    keys = [by] if by else []
    data = df.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_x"))
    q = exact_quantiles(data, "_x", [0.25, 0.5, 0.75], keys)
    q = q.select(*keys, F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo_fence = F.col("q1") - F.lit(whisker) * F.col("iqr")
    hi_fence = F.col("q3") + F.lit(whisker) * F.col("iqr")
    joined = with_series_stats(data, q, keys)
    agg = joined.groupBy(*keys, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("_x") >= lo_fence, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(F.col("_x") <= hi_fence, F.col("_x"))).alias("whisker_hi"),
        F.count_if((F.col("_x") < lo_fence) | (F.col("_x") > hi_fence)).alias("outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return agg


def distinct_counts(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (``nunique``), one row per column."""
    f = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    one = df.agg(*[f(c).alias(f"{c}__n_distinct") for c in cols])
    return _stack(one, cols, ["n_distinct"])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """``select_dtypes(include='number')`` from the schema (no job)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """``select_dtypes(include='object')`` from the schema (no job)."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in exclude]


# ---------------------------------------------------------------------------
# Feature engineering shared by EDA, significance tests and preparation.
# ---------------------------------------------------------------------------
def engineer(df: DataFrame, end_date: str = HISTORY_END_DATE, income_q: float = 0.99, cap_scope: DataFrame | None = None, cap=None) -> DataFrame:
    """History years, derogatory flag, income capped at its 0.99 quantile
    (clip keeps missing), employment years and grade ordinal.

    The cap is fitted on ``cap_scope`` (default: the same rows, as the
    reference does before its split) in a one-row aggregate, broadcast back;
    a ``cap`` that is given (a column) is used as it is.
    """
    scope = cap_scope if cap_scope is not None else df
    cap = cap if cap is not None else scalar_values(exact_quantiles(scope, "annual_inc", [income_q]).select(F.col("q_0").alias("_income_cap")))["_income_cap"]
    out = (
        df.withColumn("_income_cap", cap)
        .withColumn("credit_history_years", years_until(month_text_to_date("earliest_cr_line"), end_date))
        .withColumn("has_derogatory", positive_flag("pub_rec"))
        .withColumn("annual_inc", clip_keep_null("annual_inc", 0.0, F.col("_income_cap")))
        .withColumn("emp_length", recode("emp_length", EMP_LENGTH_YEARS).cast("double"))
        .withColumn("grade", recode("grade", GRADE_ORDINAL).cast("double"))
        .drop("earliest_cr_line", "pub_rec", "_income_cap")
    )
    return out


def hypothesis_summary(df: DataFrame, target: str = "target", digits: int = 6) -> DataFrame:
    """H1-H5 values per class in ONE groupBy(target), unpivoted:
    (feature, statistic, default_value, paid_value, difference, pct_difference).

    ``df`` is the labelled table with the engineered ``credit_history_years``,
    raw ``pub_rec`` and income capped as ``annual_inc_capped``."""
    specs = [
        ("dti", "median", None),
        ("credit_history_years", "median", None),
        ("annual_inc_capped", "median", None),
        ("pub_rec", "mean", F.avg("pub_rec")),
    ]
    d = df.filter(F.col(target).isNotNull())
    means = d.groupBy(target).agg(*[e.alias(n) for n, _, e in specs if e is not None])
    # Exact class medians in one bucketed job (no value->count map merged in one task).
    per_class = means.join(medians(d, [n for n, _, e in specs if e is None], [target]), target, "left")
    pivoted = per_class.agg(
        *[F.max(F.when(F.col(target) == 1, F.col(n))).alias(f"{n}__default_value") for n, _, _ in specs],
        *[F.max(F.when(F.col(target) == 0, F.col(n))).alias(f"{n}__paid_value") for n, _, _ in specs],
    )
    pivoted = pivoted.select("*", *[F.lit(s).alias(f"{n}__statistic") for n, s, _ in specs])
    long = _stack(pivoted, [n for n, _, _ in specs], ["statistic", "default_value", "paid_value"], key="feature")
    return long.select(
        "feature", "statistic",
        F.round("default_value", digits).alias("default_value"),
        F.round("paid_value", digits).alias("paid_value"),
        F.round(F.col("default_value") - F.col("paid_value"), digits).alias("difference"),
        F.round((F.col("default_value") - F.col("paid_value")) / F.col("paid_value") * 100, digits).alias("pct_difference"),
    )
