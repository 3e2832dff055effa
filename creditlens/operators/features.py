"""Feature preparation: fit on one table, apply to another.

Fitted state is a handful of numbers per column (medians, modes, levels,
means and deviations) computed by ONE aggregate over the fit table; applying
it is a pure projection with literals, so it fuses into the scan's codegen
stage.  ``operators/preparation.py`` wraps the same steps as Spark ML stages
that are saved and loaded as one ``PipelineModel``.

Semantics follow the reference (pandas / scikit-learn):
* median imputation is exact (linear interpolation), mode ties take the
  smallest value;
* one-hot drops the alphabetically first level, names ``<col>_<level>``;
* scaling uses the population deviation, zero deviation divides by 1, and
  only columns with more than two distinct fit values are scaled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_values
from .prefix import medians
from .profile import numeric_columns, string_columns

# Multiplicative hash on the numeric id (integer arithmetic so any SQL engine
# can repeat the split): h = ((id mod M) * A) mod M.
HASH_M = 2147483647
HASH_A = 48271


# ---------------------------------------------------------------------------
# Imputation
# ---------------------------------------------------------------------------
def fit_imputer(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], accuracy: int | None = None) -> dict:
    """Medians of numeric columns and modes of categoricals.

    Exact medians run as one rank job over all numeric columns
    (``accuracy=`` switches to ``percentile_approx``); modes are found by counts per value."""
    out = {"median": {}, "mode": {}}
    if numeric and accuracy:
        row = df.agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in numeric]).first()
        out["median"] = {c: row[c] for c in numeric}
    elif numeric:
        row = medians(df, numeric).first()
        out["median"] = {c: row[c] for c in numeric}
    for c in categorical:
        out["mode"][c] = mode_of(df, c)
    return out


def mode_of(df: DataFrame, col: str):
    """The most frequent value (ties: the smallest) by counts per value and a one-row
    arg-max, so a column of many values is never gathered in one task."""
    counts = df.filter(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m")).first()["m"]["v"] if not counts.isEmpty() else None


def apply_imputer(df: DataFrame, stats: dict) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in stats["median"] and stats["median"][c] is not None:
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(float(stats["median"][c]))).alias(c))
        elif c in stats["mode"] and stats["mode"][c] is not None:
            cols.append(F.coalesce(F.col(c), F.lit(stats["mode"][c])).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# One-hot with the first level dropped
# ---------------------------------------------------------------------------
#: Levels that a column may have to be encoded, one column each.
MOST_LEVELS = 1000


class TooManyLevels(ValueError):
    """A column has more levels than an encoding may have columns."""


def fit_levels(df: DataFrame, categorical: Sequence[str], most: int = MOST_LEVELS) -> dict:
    """Sorted distinct levels per categorical column. A sketch of the numbers of levels is
    checked first, and a column with more than ``most`` levels raises ``TooManyLevels``, so
    that what is gathered is bounded; levels are never cut off."""
    if not categorical:
        return {}
    about = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), 0.02).alias(c) for c in categorical]).first()
    # The sketch errs by a few percent; close calls are settled by the exact count below.
    far = {c: about[c] for c in categorical if about[c] > 1.2 * most + 10}
    if far:
        raise TooManyLevels(f"about as many levels, where {most} may be: {far}")
    out = {}
    for c in categorical:
        rows = df.select(F.col(f"`{c}`").alias("v")).filter("v IS NOT NULL").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise TooManyLevels(f"{c} has more than {most} levels")
        out[c] = sorted(r["v"] for r in rows)
    return out


def apply_one_hot(df: DataFrame, levels: dict, drop_first: bool = True, keep_original: bool = False) -> DataFrame:
    out = []
    for c in df.columns:
        if c in levels:
            if keep_original:
                out.append(F.col(c))
            lv = levels[c][1:] if drop_first else levels[c]
            out += [(F.col(c) == F.lit(v)).cast("int").alias(f"{c}_{v}") for v in lv]
        else:
            out.append(F.col(c))
    return df.select(*out)


# ---------------------------------------------------------------------------
# Stratified split (exact per-class sizes, no single-task window)
# ---------------------------------------------------------------------------
def id_hash(id_col: str = "id"):
    idn = F.col(id_col).cast("bigint")
    return F.pmod(F.pmod(idn, F.lit(HASH_M)) * F.lit(HASH_A), F.lit(HASH_M))


def stratified_split(
    df: DataFrame,
    target: str = "target",
    test_fraction: float = 0.2,
    id_col: str = "id",
    rows_per_bucket: int = 1_000_000,
    out: str = "is_test",
) -> DataFrame:
    """Per class, the ``floor(frac * n_class + 0.5)`` rows with the smallest
    (hash(id), id) go to the test side.

    Scalable form: hash values are cut into B equal ranges (B from the row
    count so a range holds ~``rows_per_bucket`` rows; hashing spreads any
    class or id skew evenly), row numbers are taken inside each (class, range)
    window and shifted by the range's offset from the small (class x B)
    count table."""
    base = df.filter(F.col(target).isNotNull()).withColumn("_h", id_hash(id_col)).withColumn("_idn", F.col(id_col).cast("bigint"))
    n = base.count()
    buckets = max(1, math.ceil(n / rows_per_bucket))
    base = base.withColumn("_b", F.floor(F.col("_h") * F.lit(float(buckets)) / F.lit(float(HASH_M))).cast("int"))
    counts = base.groupBy(target, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    w_off = Window.partitionBy(target).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        target, "_b",
        F.coalesce(F.sum("_nb").over(w_off), F.lit(0)).alias("_off"),
        F.floor(F.lit(test_fraction) * F.sum("_nb").over(Window.partitionBy(target)) + F.lit(0.5)).alias("_k"),
    )
    w_in = Window.partitionBy(target, "_b").orderBy("_h", "_idn")
    ranked = base.join(F.broadcast(offsets), [target, "_b"], "inner").withColumn("_rank", F.row_number().over(w_in) + F.col("_off"))
    return ranked.withColumn(out, F.col("_rank") <= F.col("_k")).drop("_h", "_idn", "_b", "_off", "_k", "_rank")


def radix_split(df: DataFrame, target: str = "target", test_fraction: float = 0.2, id_col: str = "id",
                out: str = "is_test", digits: int = 4, levels: int = 2) -> DataFrame:
    """``stratified_split`` for ids of any type: per class, the ``floor(frac * n_class + 0.5)``
    rows with the smallest (md5 of the id's text, id) go to the test side.

    Radix selection: counts per class and first ``digits`` hexadecimal digits tell in which
    group of hashes the class's cut falls; that group alone is counted by the next digits, and
    after ``levels`` rounds only the rows of the last group, a 16 ** (digits * levels)-th of the
    class, are ranked. All other rows are decided by comparing digits, without a window.
    A null id has the hash of an empty text; rows of one id are ranked in no fixed order, but
    their number on each side is exact.
    """
    base = df.filter(F.col(target).isNotNull()).withColumn("_h", F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))))
    left = base.groupBy(target).agg(F.floor(F.lit(test_fraction) * F.count(F.lit(1)) + F.lit(0.5)).alias("_k"))
    inside, decided = base.join(left, target), []
    for level in range(levels):
        group = inside.withColumn("_g", F.substring("_h", level * digits + 1, digits))
        counts = group.groupBy(target, "_g").agg(F.count(F.lit(1)).alias("_n"), F.first("_k").alias("_k"))  # 16 ** digits a class
        w = Window.partitionBy(target).orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cuts = counts.withColumn("_up", F.sum("_n").over(w)).filter("_up - _n < _k AND _k <= _up")
        cuts = cuts.select(target, F.col("_g").alias("_cut"), (F.col("_k") - F.col("_up") + F.col("_n")).alias("_rest"))
        both = group.join(cuts, target, "left")  # no cut: none of the class is taken
        sure = both.filter("_cut IS NULL OR _g <> _cut").withColumn(out, F.coalesce(F.col("_g") < F.col("_cut"), F.lit(False)))
        decided.append(sure.select(*df.columns, out))
        inside = both.filter("_g = _cut").withColumn("_k", F.col("_rest")).select(*df.columns, "_h", "_k")
    rank = F.row_number().over(Window.partitionBy(target).orderBy("_h", F.col(f"`{id_col}`").cast("string")))
    result = inside.withColumn(out, rank <= F.col("_k")).select(*df.columns, out)
    for d in decided:
        result = result.unionByName(d)
    return result


# ---------------------------------------------------------------------------
# Population-deviation scaler
# ---------------------------------------------------------------------------
def fit_scaler(df: DataFrame, cols: Sequence[str], min_distinct: int = 3) -> dict:
    """Mean / population std of columns with at least ``min_distinct`` (3)
    distinct values.  'More than two distinct values' is decided without a
    count-distinct: a column has >2 values iff some value lies strictly
    between its min and max (two cheap aggregates)."""
    assert min_distinct == 3
    row = df.agg(*[F.min(c).alias(f"lo__{c}") for c in cols], *[F.max(c).alias(f"hi__{c}") for c in cols],
                 *[F.avg(c).alias(f"mu__{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd__{c}") for c in cols]).first()
    present = [c for c in cols if row[f"lo__{c}"] is not None]
    mid = df.agg(*[F.count_if((F.col(c) > F.lit(row[f"lo__{c}"])) & (F.col(c) < F.lit(row[f"hi__{c}"]))).alias(c)
                   for c in present]).first() if present else {}
    scale_cols = [c for c in present if mid[c] > 0]
    return {"mean": {c: row[f"mu__{c}"] for c in scale_cols},
            "std": {c: (row[f"sd__{c}"] if row[f"sd__{c}"] else 1.0) for c in scale_cols}}


def apply_scaler(df: DataFrame, stats: dict) -> DataFrame:
    cols = []
    for c in df.columns:
        if c in stats["mean"]:
            cols.append(((F.col(c) - F.lit(float(stats["mean"][c]))) / F.lit(float(stats["std"][c]))).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# The whole preparation (select -> engineer -> impute -> encode -> split -> scale)
# ---------------------------------------------------------------------------
PREP_FEATURES = ["dti", "earliest_cr_line", "purpose", "annual_inc", "pub_rec", "loan_amnt", "int_rate", "installment",
                 "grade", "emp_length", "home_ownership", "verification_status", "open_acc", "revol_bal", "revol_util",
                 "total_acc", "mort_acc", "delinq_2yrs", "inq_last_6mths", "target"]


def prepare(labelled: DataFrame, id_col: str = "id", test_fraction: float = 0.2, checkpoint: bool = True) -> tuple[DataFrame, dict]:
    """Returns (prepared table with ``is_test``, fitted statistics).

    Imputation and encoding are fitted on all labelled rows (null targets
    included) as the reference does; null-target rows are then dropped, the
    split taken, and the scaler fitted on the training side only.  The split
    table is checkpointed once into the shared checkpoint folder, so the scaler
    passes and the final output read it instead of re-running the split."""
    from ..session import checkpoint_dir
    from .profile import engineer

    feats = [c for c in PREP_FEATURES if c in labelled.columns]
    base = engineer(labelled.select(id_col, *feats))
    num = numeric_columns(base, [id_col, "target"])
    cat = string_columns(base, [id_col, "target"])
    imp = fit_imputer(base, num, cat)
    imputed = apply_imputer(base, imp)
    levels = fit_levels(imputed, cat)
    encoded = apply_one_hot(imputed, levels)
    split = stratified_split(encoded, "target", test_fraction, id_col)
    if checkpoint:
        checkpoint_dir(split.sparkSession)
        split = split.checkpoint(eager=True)
    train = split.filter(~F.col("is_test"))
    feature_cols = [c for c in encoded.columns if c not in (id_col, "target")]
    scaler = fit_scaler(train, feature_cols)
    prepared = apply_scaler(split, scaler)
    return prepared, {"impute": imp, "levels": levels, "scaler": scaler, "features": feature_cols}


def class_weights(df: DataFrame, target: str = "target") -> DataFrame:
    """Balanced weights n / (2 n_class) per class and the positive-class weight
    negatives / positives (one aggregate)."""
    agg = df.filter(F.col(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("n_pos"), F.count_if(F.col(target) == 0).alias("n_neg"))
    return agg.select(
        "n", "n_pos", "n_neg",
        (F.col("n") / (F.lit(2.0) * F.col("n_neg"))).alias("weight_neg_balanced"),
        (F.col("n") / (F.lit(2.0) * F.col("n_pos"))).alias("weight_pos_balanced"),
        (F.col("n_neg") / F.col("n_pos")).alias("scale_pos_weight"),
    )


def with_weight(df: DataFrame, weights: DataFrame, mode: str = "balanced", target: str = "target", out: str = "weight") -> DataFrame:
    """Attach a per-row weight column from the one-row weights table (its
    values enter as one scalar subquery)."""
    w = scalar_values(weights)
    if mode == "balanced":
        col = F.when(F.col(target) == 1, w["weight_pos_balanced"]).otherwise(w["weight_neg_balanced"])
    else:
        col = F.when(F.col(target) == 1, w["scale_pos_weight"]).otherwise(F.lit(1.0))
    return df.withColumn(out, col)
