"""Statistical tests as Spark jobs.

* every per-column statistic is one aggregate over the table, unpivoted;
* rank tests collapse rows to (feature, value) class counts and rank them with
  the bucketed prefix sum — no single-partition window;
* p-values are computed by a Pandas UDF over the per-feature result rows
  (one row per feature), from the distribution tails in ``functions.special``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import special
from ..functions.recode import VIF_ELSE, VIF_VERDICTS, above_label
from .prefix import running_sums


@F.pandas_udf(DoubleType())
def _t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([special.t_two_sided_p(a, b) for a, b in zip(t.astype(float), dof.astype(float))])


@F.pandas_udf(DoubleType())
def _chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_sf(a, b) for a, b in zip(stat.astype(float), dof.astype(float))])


@F.pandas_udf(DoubleType())
def _norm_p(z: pd.Series) -> pd.Series:
    return pd.Series([special.norm_two_sided_from_z(a) for a in z.astype(float)])


def _long(df: DataFrame, features: Sequence[str], target: str, cast: str | None = "double") -> DataFrame:
    vals = [F.struct(F.lit(c).alias("feature"), (F.col(c).cast(cast) if cast else F.col(c)).alias("value")) for c in features]
    return df.select(target, F.explode(F.array(*vals)).alias("_s")).select("_s.feature", "_s.value", target)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows that have both values; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def point_biserial(df: DataFrame, features: Sequence[str], target: str = "target", alpha: float = 0.05,
                   with_p: bool = True) -> DataFrame:
    """Pearson r of each feature with the 0/1 target (one aggregate), t statistic
    and two-sided p. ``n`` counts the rows that have the feature and the target; others are skipped."""
    d = df.filter(F.col(target).isNotNull())
    one = d.agg(*[F.struct(F.count(c).alias("n"), pearson(F.col(c).cast("double"), F.col(target).cast("double")).alias("r")).alias(c) for c in features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.n").alias("n"), F.col(f"`{c}`.r").alias("correlation")) for c in features])).alias("_s"))
    long = long.select("_s.feature", "_s.n", "_s.correlation")
    r = F.col("correlation")
    long = long.withColumn("t_stat", r * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), F.lit(1.0) - r * r)))
    if with_p:
        long = long.withColumn("p_value", _t_p(F.col("t_stat"), (F.col("n") - 2).cast("double")))
        long = long.withColumn("significant", F.when(F.col("p_value") < alpha, "YES").otherwise("NO"))
    return long


def _median_of(count: str) -> Column:
    """Median of ``value`` (linear interpolation) over rows of running sums of ``count``, as an aggregate."""
    pos = (F.col(f"{count}_tot") - 1) / F.lit(2.0)
    at = lambda p: F.max(F.when((F.col(f"{count}_cum") - F.col(count) <= p) & (p < F.col(f"{count}_cum")), F.col("value")))
    lo, hi = at(F.floor(pos)), at(F.ceil(pos))
    return lo + (hi - lo) * (F.max(pos) - F.max(F.floor(pos)))


def mann_whitney(df: DataFrame, features: Sequence[str], target: str = "target", alpha: float = 0.05,
                 with_p: bool = True, ranges: int | None = None) -> DataFrame:
    """Two-sided Mann-Whitney U of class 0 vs class 1 per feature, tie-corrected
    normal approximation with continuity correction, plus class medians.

    U (of class 0) = R0 - n0(n0+1)/2 with mid-ranks over tied values; the tie
    term Σ(t³ - t) enters the deviation. The medians come from the same ranked
    counts, by each class's own running sum."""
    d = df.filter(F.col(target).isNotNull())
    long = _long(d, features, target).filter(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(
        F.count_if(F.col(target) == 0).cast("double").alias("c0"), F.count_if(F.col(target) == 1).cast("double").alias("c1"))
    counts = counts.withColumn("t", F.col("c0") + F.col("c1"))
    ranked = running_sums(counts, "value", ["t", "c0", "c1"], keys=["feature"], ranges=ranges)
    midrank = F.col("t_cum") - F.col("t") + (F.col("t") + F.lit(1.0)) / F.lit(2.0)
    per = ranked.groupBy("feature").agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"),
        F.sum(F.col("c0") * midrank).alias("r0"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_term"),
        _median_of("c0").alias("median_paid"), _median_of("c1").alias("median_default"),
    )
    n0, n1 = F.col("n0"), F.col("n1")
    n = n0 + n1
    u0 = F.col("r0") - n0 * (n0 + F.lit(1.0)) / F.lit(2.0)
    per = per.withColumn("u_statistic", u0)
    mu = n0 * n1 / F.lit(2.0)
    sigma = F.sqrt(n0 * n1 / F.lit(12.0) * ((n + F.lit(1.0)) - F.try_divide(F.col("tie_term"), n * (n - F.lit(1.0)))))
    big_u = F.greatest(F.col("u_statistic"), n0 * n1 - F.col("u_statistic"))
    per = per.withColumn("z", F.try_divide(big_u - mu - F.lit(0.5), sigma))
    out = per.select(
        "feature", n0.cast("long").alias("n_paid"), n1.cast("long").alias("n_default"), "u_statistic", "tie_term", "z",
        "median_paid", "median_default")
    if with_p:
        out = out.withColumn("p_value", _norm_p(F.col("z")))
        out = out.withColumn("significant", F.when(F.col("p_value") < alpha, "YES").otherwise("NO"))
    return out


def chi_square(df: DataFrame, categorical: Sequence[str], target: str = "target", alpha: float = 0.05,
               with_p: bool = True) -> DataFrame:
    """Independence test of each categorical column with the target on its full
    contingency table (zero cells included); Yates correction when dof = 1."""
    d = df.filter(F.col(target).isNotNull())
    long = _long(d, categorical, target, cast="string").filter(F.col("value").isNotNull())
    obs = long.groupBy("feature", "value", target).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = obs.groupBy("feature", "value").agg(F.sum("o").alias("row_n"))
    cols = obs.groupBy("feature", target).agg(F.sum("o").alias("col_n"))
    tot = obs.groupBy("feature").agg(F.sum("o").alias("n"), F.countDistinct("value").alias("r"), F.countDistinct(target).alias("c"))
    # All cells of each feature's table: levels x classes, both tiny per feature.
    cells = rows.join(cols, "feature").join(tot, "feature").join(obs, ["feature", "value", target], "left")
    cells = cells.withColumn("o", F.coalesce("o", F.lit(0.0))).withColumn("e", F.col("row_n") * F.col("col_n") / F.col("n"))
    cells = cells.withColumn("dof", (F.col("r") - 1) * (F.col("c") - 1))
    diff = F.col("o") - F.col("e")
    yates = F.least(F.lit(0.5), F.abs(diff))
    term = F.when(F.col("dof") == 1, F.pow(F.abs(diff) - yates, 2)).otherwise(diff * diff) / F.col("e")
    out = cells.groupBy("feature", "dof").agg(F.sum(term).alias("chi2_stat"))
    if with_p:
        out = out.withColumn("p_value", _chi2_p(F.col("chi2_stat"), F.col("dof").cast("double")))
        out = out.withColumn("significant", F.when(F.col("p_value") < alpha, "YES").otherwise("NO"))
    return out


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations (i < j), long form, over the rows that have both values.

    One pass, lazily: a task takes each batch of rows column by column and keeps mergeable
    co-moments (count, means, centred products and extremes) for each of the k(k-1)/2 pairs,
    so rows are never multiplied by pairs and a task sends one row a pair. A pair in which
    either side is constant, or that no row has, is null."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    parts = ["n", "mx", "my", "cxx", "cyy", "cxy", "lx", "hx", "ly", "hy"]

    def merged(p):
        """Moments (parts, pairs) of moments (pieces, parts, pairs); pieces of no rows count nothing."""
        n, mx, my, cxx, cyy, cxy, lx, hx, ly, hy = np.moveaxis(p, 1, 0)
        some = n > 0
        total = np.maximum(n.sum(0), 1)
        ax, ay = np.where(some, n * mx, 0).sum(0) / total, np.where(some, n * my, 0).sum(0) / total
        dx, dy = np.where(some, mx - ax, 0), np.where(some, my - ay, 0)
        least, most = lambda v: np.where(some, v, np.inf).min(0), lambda v: np.where(some, v, -np.inf).max(0)
        return np.array([n.sum(0), ax, ay, (cxx + n * dx * dx).sum(0), (cyy + n * dy * dy).sum(0), (cxy + n * dx * dy).sum(0),
                         least(lx), most(hx), least(ly), most(hy)])

    def of_batch(values, there):
        out = np.zeros((len(parts), len(pairs)))
        for at, (i, j) in enumerate(pairs):
            both = there[i] & there[j]
            n = np.count_nonzero(both)
            if n:
                x, y = values[i][both], values[j][both]
                mx, my = x.mean(), y.mean()
                dx, dy = x - mx, y - my
                out[:, at] = n, mx, my, dx @ dx, dy @ dy, dx @ dy, x.min(), x.max(), y.min(), y.max()
        return out

    def moments(batches):
        kept = None
        with np.errstate(all="ignore"):
            for batch in batches:
                there = [c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]
                now = of_batch([c.fill_null(0.0).to_numpy() for c in batch.columns], there)
                kept = now if kept is None else merged(np.array([kept, now]))
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs)), pa.int32()), *map(pa.array, kept)], ["i", *parts])

    def correlation(table):
        with np.errstate(all="ignore"):
            n, _, _, cxx, cyy, cxy, lx, hx, ly, hy = merged(np.array([table[c].to_numpy() for c in parts]).T[:, :, None])[:, 0]
            below = np.sqrt(cxx) * np.sqrt(cyy)
            flat = n == 0 or hx - lx == 0 or hy - ly == 0 or below == 0
            return pa.table({"i": table["i"][:1], "correlation": pa.array([None if flat else cxy / below], pa.float64())})

    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    one = wide.mapInArrow(moments, "i int, " + ", ".join(f"{c} double" for c in parts))
    found = one.groupBy("i").applyInArrow(correlation, "i int, correlation double")
    names = df.sparkSession.createDataFrame([(at, cols[i], cols[j]) for at, (i, j) in enumerate(pairs)], "i int, feature_1 string, feature_2 string")
    return names.join(found, "i", "left").select("feature_1", "feature_2", "correlation")


def high_correlation_pairs(pairs: DataFrame, threshold: float = 0.7, digits: int = 3) -> DataFrame:
    return pairs.filter(F.abs("correlation") > threshold).select(
        "feature_1", "feature_2", F.round("correlation", digits).alias("correlation")).orderBy(F.abs("correlation").desc())


def gram_matrix(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """X'X over rows with no null in ``cols`` — one distributed aggregate of
    k(k+1)/2 product sums; the k x k result is the only thing collected."""
    d = df.na.drop(subset=list(cols))
    idx = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = d.agg(*[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"g{i}_{j}") for i, j in idx]).first()
    g = np.zeros((len(cols), len(cols)))
    for i, j in idx:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return g


def vif(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Variance inflation factors without an intercept (uncentred R²), as a
    regression of each raw column on the others: VIF_i = G_ii (G^-1)_ii."""
    g = gram_matrix(df, cols)
    inv = np.linalg.pinv(g)
    vals = [float(g[i, i] * inv[i, i]) for i in range(len(cols))]
    spark = df.sparkSession
    out = spark.createDataFrame([(c, float(round(v, digits)) if math.isfinite(v) else v) for c, v in zip(cols, vals)], "feature string, VIF double")
    return out.withColumn("verdict", above_label("VIF", VIF_VERDICTS, VIF_ELSE)).orderBy(F.col("VIF").desc())


def feature_ranking(pb: DataFrame, mw: DataFrame, digits: int = 4) -> DataFrame:
    """Point-biserial and Mann-Whitney results side by side, ordered by |r|."""
    a = pb.select("feature", F.round("correlation", digits).alias("pb_correlation"), F.col("significant").alias("pb_significant"))
    b = mw.select("feature", F.col("p_value").alias("mw_pvalue"), F.col("significant").alias("mw_significant"))
    return a.join(b, "feature", "inner").orderBy(F.abs("pb_correlation").desc(), "feature")
