"""Evaluation of scored rows ``(target, score)`` and choice of a cut-off.

Everything starts by collapsing rows to ``(score, n_pos, n_neg)`` with a
partial-aggregated ``groupBy``; curves and AUC then run over distinct scores
with the bucketed prefix sum (no single-partition window), and the 80-point
threshold sweep maps every row to its grid cell so one small aggregate
replaces 80 passes.  Optional ``keys`` (e.g. ``model``) evaluate several
score series in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_values, with_series_stats
from .prefix import exact_quantiles, previous_values, running_sums

GRID_LO, GRID_HI = 10, 89  # thresholds i/100 for i in 10..89 (np.arange(0.1, 0.9, 0.01))


def collapse(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, score, n_pos, n_neg)`` — one row per distinct score."""
    return scored.filter(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))


def confusion(scored: DataFrame, threshold: float | Column, score: str = "score", label: str = "target",
              keys: Sequence[str] = ()) -> DataFrame:
    """TN, FP, FN, TP at ``score >= threshold`` plus catch and good-rejection rates."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label)
    agg = scored.filter(y.isNotNull()).groupBy(*keys).agg(
        F.count_if((y == 0) & ~pred).alias("tn"), F.count_if((y == 0) & pred).alias("fp"),
        F.count_if((y == 1) & ~pred).alias("fn"), F.count_if((y == 1) & pred).alias("tp"),
    )
    return with_rates(agg)


def with_rates(cm: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return cm.select(
        "*",
        F.try_divide(tp, tp + fn).alias("catch_rate"),
        F.try_divide(fp, tn + fp).alias("good_rejection"),
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0)).alias("precision"),
        F.when(tp > 0, (5 * tp) / (5 * tp + 4 * fn + fp)).otherwise(F.lit(0.0)).alias("f2"),
    )


def _curve_base(scored: DataFrame, score: str, label: str, keys: Sequence[str], ranges: int) -> DataFrame:
    """Distinct scores with descending cumulative counts: tps/fps at ``score >= s``."""
    c = collapse(scored, score, label, keys)
    cum = running_sums(c, score, ["n_pos", "n_neg"], keys, ranges)
    # inclusive-descending = total - ascending-inclusive + own
    return cum.select(
        *keys, score, "n_pos", "n_neg",
        (F.col("n_pos_tot") - F.col("n_pos_cum") + F.col("n_pos")).alias("tps"),
        (F.col("n_neg_tot") - F.col("n_neg_cum") + F.col("n_neg")).alias("fps"),
        (F.col("n_neg_cum") - F.col("n_neg")).alias("neg_below"),
        F.col("n_pos_tot").alias("P"), F.col("n_neg_tot").alias("N"),
    )


def auc(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact ROC-AUC with ties: Σ pos·(neg_below + neg/2) / (P·N); null where a class is empty."""
    base = _curve_base(scored, score, label, keys, ranges)
    return base.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("n_pos").cast("double") * (F.col("neg_below") + F.col("n_neg") / F.lit(2.0))),
                     F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"),
        F.first("P").alias("n_pos"), F.first("N").alias("n_neg"),
    )


def roc_curve(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """ROC points (fpr, tpr, threshold) at every distinct score, plus the (0, 0)
    start with an infinite threshold (unthinned: no collinear-point removal)."""
    base = _curve_base(scored, score, label, keys, ranges)
    pts = base.select(*keys, F.col(score).alias("threshold"), F.try_divide("fps", "N").alias("fpr"),
                      F.try_divide("tps", "P").alias("tpr"))
    start = base.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def roc_curve_thinned(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (),
                      ranges: int | None = None) -> DataFrame:
    """ROC points with collinear interior points removed (scikit-learn's
    default ``drop_intermediate``): an interior point is dropped when the next
    lower distinct score carries the same (positives, negatives) counts, i.e.
    the curve does not bend there.  The highest and lowest scores are kept."""
    base = _curve_base(scored, score, label, keys, ranges)
    prev = previous_values(base, score, ["n_pos", "n_neg"], keys, ranges)
    top = base.groupBy(*keys).agg(F.max(score).alias("_max"))
    j = with_series_stats(prev, top, keys)
    collinear = (F.col(score) < F.col("_max")) & F.col(f"prev_{score}").isNotNull() & \
        (F.col("prev_n_pos") == F.col("n_pos")) & (F.col("prev_n_neg") == F.col("n_neg"))
    kept = j.filter(~collinear).select(*keys, F.col(score).alias("threshold"), F.try_divide("fps", "N").alias("fpr"),
                                       F.try_divide("tps", "P").alias("tpr"))
    start = base.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept.unionByName(start)


def pr_curve(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Precision / recall at every distinct score, the final (1, 0) point with a
    null threshold, and F2 = 5pr/(4p+r) (0 when undefined)."""
    base = _curve_base(scored, score, label, keys, ranges)
    p = F.col("tps") / (F.col("tps") + F.col("fps"))
    r = F.try_divide("tps", "P")
    pts = base.select(*keys, F.col(score).alias("threshold"), p.alias("precision"), r.alias("recall"))
    end = base.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    out = pts.unionByName(end)
    pc, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f2", F.when(F.lit(4.0) * pc + rc > 0, F.lit(5.0) * pc * rc / (F.lit(4.0) * pc + rc)).otherwise(F.lit(0.0)))


def f2_threshold(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (),
                 digits: int = 2, ranges: int | None = None) -> DataFrame:
    """F2-optimal cut-off: arg-max of F2 over the PR points (lowest threshold on
    ties), rounded to ``digits``; one row per series."""
    pr = pr_curve(scored, score, label, keys, ranges).filter(F.col("threshold").isNotNull())
    if keys:
        # Arg-max as an aggregate (partial per task, then one row per series), not a window over a whole series.
        pick = F.max_by(F.struct("threshold", "f2", "precision", "recall"), F.struct("f2", (-F.col("threshold")).alias("_t")))
        best = pr.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")
    else:
        best = pr.orderBy(F.col("f2").desc(), F.col("threshold").asc()).limit(1)
    # Half-up rounding written out (floor(x*10^d + 0.5)/10^d) so every engine agrees on the cut-off.
    scale = float(10 ** digits)
    rounded = F.floor(F.col("threshold") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return best.select(*keys, rounded.alias("threshold"), F.col("threshold").alias("raw_threshold"), "f2", "precision", "recall")


def grid_cell(score: Column, lo: int = GRID_LO, hi: int = GRID_HI) -> Column:
    """Largest grid index i with i/100 <= score, clamped to [lo-1, hi]
    (lo-1 = below every cut-off).  Written with the same doubles as ``i/100.0``."""
    c = F.floor(score * F.lit(100.0)).cast("int")
    k = F.when((c + 1).cast("double") / F.lit(100.0) <= score, c + 1).when(c.cast("double") / F.lit(100.0) > score, c - 1).otherwise(c)
    return F.greatest(F.lit(lo - 1), F.least(F.lit(hi), k))


def sweep(scored: DataFrame, score: str = "score", label: str = "target", keys: Sequence[str] = (),
          lo: int = GRID_LO, hi: int = GRID_HI) -> DataFrame:
    """Confusion counts and rates at every cut-off i/100, i = lo..hi, in one pass:
    rows are counted per grid cell (≤ 81 cells), then suffix sums over cells."""
    keys = list(keys)
    y = F.col(label)
    cells = scored.filter(y.isNotNull()).groupBy(*keys, grid_cell(F.col(score), lo, hi).alias("i")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    # Every series gets the full grid lo..hi (plus the below-grid cell lo-1, which
    # only counts towards the totals); cells are <= 82 rows per series.
    grid = cells.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(lo - 1), F.lit(hi))).alias("i")) if keys else \
        scored.sparkSession.range(lo - 1, hi + 1).select(F.col("id").cast("int").alias("i"))
    full = grid.join(cells, keys + ["i"], "left").select(
        *keys, "i", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    # Predicted positive at cut-off i  <=>  cell >= i: suffix sums over the cells of a series.
    suffix = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    res = full.select(
        *keys, "i",
        F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"),
    ).filter(F.col("i") >= F.lit(lo))
    res = res.select(
        *keys, (F.col("i").cast("double") / F.lit(100.0)).alias("threshold"), "tp", "fp",
        (F.col("N") - F.col("fp")).alias("tn"), (F.col("P") - F.col("tp")).alias("fn"),
    )
    return with_rates(res)


def constrained_threshold(sw: DataFrame, base: float = 0.5, catch_mult: float = 1.30, max_extra: float = 0.10,
                          fallback: float = 0.4) -> DataFrame:
    """Business rule: catch >= catch_mult x catch(base) and good-rejection <= good-rejection(base) + max_extra;
    pick the lowest good-rejection (lowest cut-off on ties); if none qualifies, the fallback cut-off."""
    b = sw.filter(F.col("threshold") == F.lit(base)).select(
        (F.col("catch_rate") * F.lit(catch_mult)).alias("target_catch"),
        (F.col("good_rejection") + F.lit(max_extra)).alias("max_good_rejection"))
    bv = scalar_values(b)
    cand = sw.filter((F.col("catch_rate") >= bv["target_catch"]) & (F.col("good_rejection") <= bv["max_good_rejection"]))
    best = cand.orderBy(F.col("good_rejection").asc(), F.col("threshold").asc()).limit(1).select(
        "threshold", F.lit("constraint").alias("chosen_by"))
    fb = sw.sparkSession.range(1).select(F.lit(float(fallback)).alias("threshold"), F.lit("fallback").alias("chosen_by"))
    pick = best.unionByName(fb).orderBy(F.when(F.col("chosen_by") == "constraint", 0).otherwise(1)).limit(1)
    return pick.join(sw.select("threshold", "catch_rate", "good_rejection", "f2"), "threshold", "left").select(
        "*", bv["target_catch"].alias("target_catch"), bv["max_good_rejection"].alias("max_good_rejection"))


def closest_options(sw: DataFrame, top: int = 5) -> DataFrame:
    """Fallback view: the top cut-offs by catch minus good-rejection."""
    return sw.withColumn("score", F.col("catch_rate") - F.col("good_rejection")).orderBy(
        F.col("score").desc(), F.col("threshold").asc()).limit(top)


def business_impact(cm: DataFrame) -> DataFrame:
    """Approved / rejected / caught / missed and default rates with and without the model;
    a rate whose denominator is zero (no rows, no defaults, no good loans) is null."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    approved = tn + fn
    no_model = F.try_divide(tp + fn, total)
    with_model = F.when(approved > 0, fn / approved).otherwise(F.lit(0.0))
    return cm.select(
        *[c for c in cm.columns if c not in ("catch_rate", "good_rejection", "precision", "f2")],
        total.alias("total"), approved.alias("approved"), (tp + fp).alias("rejected"),
        (tp + fn).alias("defaults"), tp.alias("defaults_caught"), fn.alias("defaults_missed"),
        (tn + fp).alias("good_borrowers"),
        no_model.alias("default_rate_no_model"), with_model.alias("default_rate_approved"),
        F.try_divide(no_model - with_model, no_model).alias("default_rate_reduction"),
        F.try_divide(tp, tp + fn).alias("catch_rate"), F.try_divide(fp, tn + fp).alias("good_rejection"),
        F.try_divide(tn, tn + fp).alias("good_approved_rate"),
    )


def classification_report(cm: DataFrame, names: tuple[str, str] = ("Fully Paid", "Default")) -> DataFrame:
    """Per-class precision / recall / F1 / support, accuracy, macro and weighted means (long form)."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    p0, r0, s0 = ratio(tn, tn + fn), ratio(tn, tn + fp), tn + fp
    p1, r1, s1 = ratio(tp, tp + fp), ratio(tp, tp + fn), tp + fn

    def f1(p, r):
        return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))

    n = s0 + s1
    acc = ratio(tp + tn, n)
    rows = [
        F.struct(F.lit(names[0]).alias("label"), p0.alias("precision"), r0.alias("recall"), f1(p0, r0).alias("f1"), s0.alias("support")),
        F.struct(F.lit(names[1]).alias("label"), p1.alias("precision"), r1.alias("recall"), f1(p1, r1).alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                 acc.alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f1(p0, r0) + f1(p1, r1)) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ratio(p0 * s0 + p1 * s1, n).alias("precision"), ratio(r0 * s0 + r1 * s1, n).alias("recall"),
                 ratio(f1(p0, r0) * s0 + f1(p1, r1) * s1, n).alias("f1"), n.alias("support")),
    ]
    return cm.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def score_means(scored: DataFrame, score: str = "score", label: str = "target") -> DataFrame:
    """Class mean and exact median of the score (the reference prints the mean
    under a 'median' heading; both are given, named correctly).  The median of a
    continuous score goes through the bucketed exact quantile, not a
    value->count map merged in one task."""
    d = scored.filter(F.col(label).isNotNull())
    means = d.groupBy(label).agg(F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(d, score, [0.5], keys=[label]).withColumnRenamed("q_0", "median_score")
    return means.join(med, label, "inner")


def evaluate(scored: DataFrame, threshold: float, name: str = "model", score: str = "score", label: str = "target",
             keys: Sequence[str] = ()) -> DataFrame:
    """One-call evaluation: AUC, confusion counts, rates and F2 at a cut-off."""
    cm = confusion(scored, threshold, score, label, keys)
    a = auc(scored, score, label, keys)
    out = with_series_stats(cm, a.select(*keys, "auc"), keys)
    return out.select(F.lit(name).alias("model") if not keys else F.col(keys[0]).alias("model"),
                      F.lit(float(threshold)).alias("threshold"), "auc", "tn", "fp", "fn", "tp",
                      "catch_rate", "good_rejection", "precision", "f2")
