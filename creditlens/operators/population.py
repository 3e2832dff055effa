"""Accepted-versus-rejected population study.

The reference reads a 27.6M-row file twice in 1M-row chunks with a running
Counter (year, then state) and a 500K head sample for distributions.  Here
every count is a partitioned scan + partial-aggregated ``groupBy``, both
populations are read in full (a sample is a parameter, never a head), and
the per-key tables are joined on their small aggregated forms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_values
from .prefix import exact_quantiles
from ..functions.recode import EMP_ORDER, SCORE_BANDS, half_open_band, iso_date, percent_text


def clean_rejected(rej: DataFrame, dti_col: str = "dti_text", date_col: str = "application_date",
                   emp_col: str = "emp_length") -> DataFrame:
    """Parse percent text, ISO date -> year, missing employment -> 'n/a'."""
    return (
        rej.withColumn("dti", percent_text(dti_col))
        .withColumn("year", F.year(iso_date(date_col)))
        .withColumn("emp_clean", F.coalesce(F.col(emp_col), F.lit("n/a")))
    )


def funnel(spark: SparkSession, accepted_raw: DataFrame, rejected: DataFrame, resolved: DataFrame) -> DataFrame:
    """All applications -> accepted -> resolved, counted (not typed in), with shares of all."""
    counts = (
        accepted_raw.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("stage"), F.lit(2).alias("step"), "n")
        .unionByName(rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rejected").alias("stage"), F.lit(1).alias("step"), "n"))
        .unionByName(resolved.agg(F.count(F.lit(1)).alias("n")).select(F.lit("resolved").alias("stage"), F.lit(3).alias("step"), "n"))
    )
    total = counts.filter(F.col("stage").isin("accepted", "rejected")).agg(F.sum("n").alias("_all"))
    allrow = total.select(F.lit("all_applications").alias("stage"), F.lit(0).alias("step"), F.col("_all").alias("n"))
    every = scalar_values(total)["_all"]
    return counts.unionByName(allrow).select("stage", "step", "n", (F.col("n") / every).alias("share_of_all"))


def score_bands(rej: DataFrame, score_col: str = "risk_score", lo: float = 300, hi: float = 850,
                bands=SCORE_BANDS) -> DataFrame:
    """Share of in-range scores in each named half-open band (all bands listed)."""
    valid = rej.filter(F.col(score_col).isNotNull() & (F.col(score_col) >= lo) & (F.col(score_col) <= hi))
    spark = rej.sparkSession
    band_table = spark.createDataFrame([(i, n, float(a), float(b)) for i, (a, b, n) in enumerate(bands)],
                                       "band_order int, band string, band_lo double, band_hi double")
    counts = valid.groupBy(half_open_band(score_col, bands).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    total = scalar_values(valid.agg(F.count(F.lit(1)).alias("_total")))["_total"]
    return (
        F.broadcast(band_table).join(counts, "band", "left")
        .select("band_order", "band", "band_lo", "band_hi", F.coalesce("n", F.lit(0)).alias("n"),
                (F.coalesce("n", F.lit(0)) / total).alias("share"))
    )


def compare_shares(accepted: DataFrame, acc_col: str, rejected: DataFrame, rej_col: str,
                   order: Sequence[str] = EMP_ORDER, digits: int = 1) -> DataFrame:
    """Two populations' shares aligned to a fixed ordered category list (0 when absent).

    Shares use each side's own non-null denominator (pandas ``value_counts``)."""
    spark = accepted.sparkSession
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(order)], "pos int, category string")

    def shares(df, col, name):
        nn = df.filter(F.col(col).isNotNull())
        cnt = nn.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("_n"))
        tot = scalar_values(nn.agg(F.count(F.lit(1)).alias("_t")))["_t"]
        return cnt.select("category", (F.col("_n") / tot * 100.0).alias(name))

    a = shares(accepted, acc_col, "accepted_pct")
    r = shares(rejected, rej_col, "rejected_pct")
    out = F.broadcast(cats).join(a, "category", "left").join(r, "category", "left")
    acc = F.coalesce("accepted_pct", F.lit(0.0))
    rej = F.coalesce("rejected_pct", F.lit(0.0))
    return out.select("pos", "category", F.round(acc, digits).alias("accepted_pct"), F.round(rej, digits).alias("rejected_pct"),
                      F.round(rej - acc, digits).alias("diff_pct"))


def yearly_counts(df: DataFrame, year_col: str = "year", first: int = 2007, last: int = 2018, name: str = "n") -> DataFrame:
    """Per-year counts (the reference's chunked Counter) restricted to a year window."""
    return (
        df.filter(F.col(year_col).isNotNull())
        .groupBy(F.col(year_col).alias("year")).agg(F.count(F.lit(1)).alias(name))
        .filter((F.col("year") >= first) & (F.col("year") <= last))
    )


def yearly_rejection(rej_years: DataFrame, acc_years: DataFrame) -> DataFrame:
    """Rejection rate per common year (inner join of the two yearly tables) and
    year-over-year change of rejected volume (``lag`` over the ≤12-row table)."""
    j = rej_years.join(acc_years, "year", "inner")
    w = Window.orderBy("year")
    return j.select(
        "year", "rejected", "accepted",
        (F.col("rejected") / (F.col("rejected") + F.col("accepted"))).alias("rejection_rate"),
        ((F.col("rejected") - F.lag("rejected").over(w)) / F.lag("rejected").over(w) * 100.0).alias("rejected_change_pct"),
    )


def yearly_both(rej_years: DataFrame, acc_years: DataFrame) -> DataFrame:
    """Full outer alignment of the yearly tables with 0 fill."""
    return rej_years.join(acc_years, "year", "full").select(
        "year", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("accepted", F.lit(0)).alias("accepted"))


def state_rejection(accepted: DataFrame, acc_state: str, rejected: DataFrame, rej_state: str,
                    min_total: int = 5000, top: int = 20) -> DataFrame:
    """Per-state rejection table: full outer join of the two count tables with 0
    fill, floor on the total, rank both ways, and the unweighted mean rate of
    the states that pass (the reference's 'overall' line)."""
    a = accepted.filter(F.col(acc_state).isNotNull()).groupBy(F.col(acc_state).alias("state")).agg(F.count(F.lit(1)).alias("accepted"))
    r = rejected.filter(F.col(rej_state).isNotNull()).groupBy(F.col(rej_state).alias("state")).agg(F.count(F.lit(1)).alias("rejected"))
    t = a.join(r, "state", "full").select(
        "state", F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("accepted", F.lit(0)).alias("accepted"))
    t = t.withColumn("total", F.col("rejected") + F.col("accepted")).filter(F.col("total") > min_total)
    t = t.withColumn("rej_rate", F.col("rejected") / F.col("total"))
    # Windows below run over the per-state aggregate (one row per state), not over applications.
    down = Window.orderBy(F.col("rej_rate").desc(), F.col("state"))
    up = Window.orderBy(F.col("rej_rate").asc(), F.col("state").desc())
    return t.select(
        "state", "rejected", "accepted", "total", "rej_rate",
        F.row_number().over(down).alias("rank_desc"),
        (F.row_number().over(down) <= top).alias("in_top"),
        (F.row_number().over(up) <= top).alias("in_bottom"),
        F.round(F.avg("rej_rate").over(Window.partitionBy()), 9).alias("mean_rate"),
        F.when(F.col("rej_rate") > 0.95, "red").when(F.col("rej_rate") > 0.90, "orange").otherwise("blue").alias("tier"),
    )


def population_stats(accepted: DataFrame, acc_col: str, rejected: DataFrame, rej_col: str,
                     lo: float, hi: float, lo_inclusive: bool = True, digits: int = 6) -> DataFrame:
    """Same range filter on both populations, then count / mean / exact median / sample std."""
    def one(df, col, name):
        x = F.col(col)
        cond = x.isNotNull() & ((x >= lo) if lo_inclusive else (x > lo)) & (x <= hi)
        kept = df.filter(cond)
        med = scalar_values(exact_quantiles(kept, col, [0.5]).select(F.col("q_0").alias("median")))["median"]
        return kept.agg(
            F.count(F.lit(1)).alias("n"), F.round(F.avg(col), digits).alias("mean"),
            F.round(med, 9).alias("median"), F.round(F.stddev_samp(col), digits).alias("std"),
        ).select(F.lit(name).alias("population"), "*")

    return one(accepted, acc_col, "accepted").unionByName(one(rejected, rej_col, "rejected"))


def year_and_state_counts(rej: DataFrame, year_col: str = "year", state_col: str = "state") -> DataFrame:
    """Both of the reference's chunked passes (per year, per state) in ONE scan
    with grouping sets; ``level`` tells which grouping a row belongs to."""
    g = rej.groupingSets([[year_col], [state_col]], year_col, state_col).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    return g.select(F.when(F.col("_gid") == 1, F.lit("year")).otherwise(F.lit("state")).alias("level"),
                    F.col(year_col).alias("year"), F.col(state_col).alias("state"), "n")
