"""Running sums in a global order without a single-partition window.

A plain ``Window.orderBy(x)`` with no ``partitionBy`` moves every row to one
task.  Rank statistics (AUC, ROC/PR curves, Mann-Whitney U, exact splits)
need such running sums over possibly billions of distinct values, so they go
through a two-step prefix sum instead:

1. the distinct values of all series are written once and dealt out by a range
   exchange over (series, value), whose cut points come from Spark's bounded
   sample; ranges that came out too large are divided by a second exchange.
   Each row keeps the number of its range;
2. a running sum inside each (series, range) window — many independent
   partitions — plus the range's offset, i.e. the exclusive running sum of
   range totals, computed on the small table of series and ranges (a row for
   each range and one more for each further series in it).

The source is read once, and no task merges a sketch of a whole series. A rank
job runs while it is built, as its ranges are a written table.

Input rows must be unique per (series keys, order column): collapse with a
``groupBy`` first, which also removes row skew (a value held by a third of
all rows is one row after collapsing).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_values, with_scalars
from ..session import written


#: A range is divided again where it has so many times the mean number of rows.
OVERFULL = 4


def in_ranges(df: DataFrame, order_col: str, keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range`` (and ``_part``, its piece of a divided range): rows of one
    series with a smaller (``_range``, ``_part``) have smaller values of ``order_col``."""
    spark = df.sparkSession
    order = [*keys, order_col]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = written(df, "values")
    first = written(base.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = first.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    mean = scalar_values(sizes.agg(F.avg("_size").alias("m")))["m"]
    full = [r["_range"] for r in sizes.filter(F.col("_size") > OVERFULL * mean).collect()]  # n at most
    if not full:
        return first.withColumn("_part", F.lit(0))
    again = first.filter(F.col("_range").isin(full)).repartitionByRange(n, "_range", *order).withColumn("_part", F.spark_partition_id())
    return first.filter(~F.col("_range").isin(full)).withColumn("_part", F.lit(0)).unionByName(written(again, "divided"))


def quantile_bins(df: DataFrame, order_col: str, bins: int, accuracy: int = 10000) -> DataFrame:
    """Add ``_bin``: the number of the column's approximate quantiles (``bins`` - 1 of
    them, one bounded sketch) that lie below the value."""
    cuts = df.agg(F.percentile_approx(order_col, [i / bins for i in range(1, bins)], accuracy).alias("_cuts"))
    return with_scalars(df, cuts).withColumn("_bin", F.size(F.filter("_cuts", lambda b: b < F.col(order_col)))).drop("_cuts")


_AT = ("_range", "_part")


def previous_values(df: DataFrame, order_col: str, value_cols: Sequence[str], keys: Sequence[str] = (),
                    ranges: int | None = None, prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<col>`` (and ``prev_<order_col>``): the values of the row just
    before in ascending ``order_col`` within each series (null for the first).

    ``lag`` inside each (series, range) window; the first row of a range
    takes the last row of the nearest earlier range, found with a window over
    the small table of the ranges' last rows."""
    keys = list(keys)
    cols = [order_col] + list(value_cols)
    b = in_ranges(df, order_col, keys, ranges)
    w = Window.partitionBy(*keys, *_AT).orderBy(order_col)
    local = b.select("*", *[F.lag(c).over(w).alias(f"_l_{c}") for c in cols])
    tails = b.groupBy(*keys, *_AT).agg(*[F.max_by(c, order_col).alias(f"_t_{c}") for c in cols])
    tw = Window.partitionBy(*keys).orderBy(*_AT)
    tails = tails.select(*keys, *_AT, *[F.lag(f"_t_{c}").over(tw).alias(f"_p_{c}") for c in cols])
    out = local.join(tails, [*keys, *_AT], "inner")
    first = F.col(f"_l_{order_col}").isNull()
    return out.select(*df.columns, *[F.when(first, F.col(f"_p_{c}")).otherwise(F.col(f"_l_{c}")).alias(f"{prefix}{c}") for c in cols])


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], keys: Sequence[str] = (),
                 ranges: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Add ``<col>_cum`` = inclusive running sum of ``col`` in ascending
    ``order_col`` within each ``keys`` series, and ``<col>_tot`` = series total."""
    keys = list(keys)
    placed = in_ranges(df, order_col, keys, ranges)
    local_w = Window.partitionBy(*keys, *_AT).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select("*", *[F.sum(c).over(local_w).alias(f"_{c}_local") for c in sum_cols])
    totals = placed.groupBy(*keys, *_AT).agg(*[F.sum(c).alias(f"_{c}_bt") for c in sum_cols])
    # Windows over the small table of series and ranges only.
    off_w = Window.partitionBy(*keys).orderBy(*_AT).rowsBetween(Window.unboundedPreceding, -1)
    tot_w = Window.partitionBy(*keys)
    offsets = totals.select(
        *keys, *_AT,
        *[F.coalesce(F.sum(f"_{c}_bt").over(off_w), F.lit(0)).alias(f"_{c}_off") for c in sum_cols],
        *[F.sum(f"_{c}_bt").over(tot_w).alias(f"{c}_tot") for c in sum_cols],
    )
    return local.join(offsets, [*keys, *_AT], "inner").select(
        *df.columns,
        *[(F.col(f"_{c}_local") + F.col(f"_{c}_off")).alias(f"{c}{suffix}") for c in sum_cols],
        *[F.col(f"{c}_tot") for c in sum_cols],
    )


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], keys: Sequence[str] = (),
                    ranges: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default) for columns
    with any number of distinct values: rows collapse to (value, count), ranks
    come from the running sum over ranges, and the two order statistics around
    each position p*(n-1) are picked and interpolated.  One row per series,
    one column ``q_<i>`` per probability."""
    keys = list(keys)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_sums(counts, col, ["_c"], keys, ranges)  # _c_cum (inclusive), _c_tot
    # All probabilities in one pass over the ranked distinct values.
    pe = cum.select(*keys, col, "_c", "_c_cum", "_c_tot",
                    F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("_i", "_p"))
    pos = F.col("_p") * (F.col("_c_tot") - 1)
    first = F.col("_c_cum") - F.col("_c")  # 0-based rank of the value's first row
    hit = pe.select(
        *keys, "_i", F.col(col).cast("double").alias("_v"), pos.alias("_pos"),
        ((first <= F.floor(pos)) & (F.floor(pos) < F.col("_c_cum"))).alias("_is_lo"),
        ((first <= F.ceil(pos)) & (F.ceil(pos) < F.col("_c_cum"))).alias("_is_hi"),
    ).filter("_is_lo OR _is_hi")
    q = hit.groupBy(*keys, "_i").agg(
        F.max(F.when(F.col("_is_lo"), F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_is_hi"), F.col("_v"))).alias("_hi"),
        F.first("_pos").alias("_pos"))
    q = q.select(*keys, "_i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias("_q"))
    return q.groupBy(*keys).pivot("_i", list(range(len(probs)))).agg(F.first("_q")).select(
        *keys, *[F.col(str(i)).alias(f"q_{i}") for i in range(len(probs))])


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                     ranges: int | None = None, feature: str = "feature") -> DataFrame:
    """Exact quantiles of several columns at once: the columns are unpivoted to
    (keys, feature, value), and every (keys, feature) pair is one series of
    ``exact_quantiles``.  One row per (keys, feature) with ``q_<i>``; a column
    with no non-null value has no row.  Nothing is merged in one task: values
    collapse to counts per task, ranks come from the running sums over ranges."""
    keys = list(keys)
    pairs = F.array(*[F.struct(F.lit(c).alias("_f"), F.col(f"`{c}`").cast("double").alias("_v")) for c in cols])
    long = df.select(*keys, F.explode(pairs).alias("_s")).select(*keys, F.col("_s._f").alias(feature), F.col("_s._v").alias("_v"))
    return exact_quantiles(long, "_v", probs, keys=keys + [feature], ranges=ranges)


def medians(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians (linear interpolation) of ``cols`` per ``keys``, wide: one
    row per key combination, one column per input column (null when a column
    has no value in that group)."""
    keys = list(keys)
    long = column_quantiles(df, cols, [0.5], keys)
    g = long.groupBy(*keys) if keys else long.groupBy()
    return g.pivot("feature", list(cols)).agg(F.first("q_0"))
