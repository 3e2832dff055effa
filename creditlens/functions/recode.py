"""Column-level recodes.  All return ``Column`` expressions built from JVM-side
functions, so they stay inside whole-stage codegen and push nothing through
Python.  Null handling follows pandas semantics the reference relies on
(see README, "semantics that differ from a naive port")."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# ---------------------------------------------------------------------------
# Loan statuses removed before labelling (ambiguous outcomes).
DROP_STATUSES = ["Current", "Late (31-120 days)", "Late (16-30 days)", "In Grace Period", "Default"]
# Status -> binary target; unmapped (and null) statuses give a null target.
STATUS_TARGET = {
    "Fully Paid": 0,
    "Does not meet the credit policy. Status:Fully Paid": 0,
    "Charged Off": 1,
    "Does not meet the credit policy. Status:Charged Off": 1,
}
# Employment length text -> years.
EMP_LENGTH_YEARS = {
    "< 1 year": 0, "1 year": 1, "2 years": 2, "3 years": 3, "4 years": 4, "5 years": 5,
    "6 years": 6, "7 years": 7, "8 years": 8, "9 years": 9, "10+ years": 10,
}
EMP_ORDER = ["< 1 year", "1 year", "2 years", "3 years", "4 years", "5 years",
             "6 years", "7 years", "8 years", "9 years", "10+ years"]
# Grade letter -> ordinal.
GRADE_ORDINAL = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
# Fixed end date of credit-history years.
HISTORY_END_DATE = "2018-12-31"
# Words a CSV reader must treat as missing (pandas defaults the reference inherits).
NULL_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Income brackets (upper bounds, exclusive) and labels; everything else -> last label.
INCOME_BOUNDS = [30000, 50000, 75000, 100000, 150000]
INCOME_LABELS = ["1. <$30K", "2. $30K-$50K", "3. $50K-$75K", "4. $75K-$100K", "5. $100K-$150K", "6. >$150K"]
# Debt-to-income buckets.
DTI_BOUNDS = [5, 10, 15, 20, 25, 30, 35]
DTI_LABELS = ["01. 0-5", "02. 5-10", "03. 10-15", "04. 15-20", "05. 20-25", "06. 25-30", "07. 30-35", "08. 35+"]
# Risk-score bands, half-open [lo, hi).
SCORE_BANDS = [
    (300, 580, "Very Poor (<580)"),
    (580, 670, "Fair (580-669)"),
    (670, 740, "Good (670-739)"),
    (740, 800, "Very Good (740-799)"),
    (800, 851, "Exceptional (800+)"),
]
# Purpose risk labels by default rate.
RISK_LABELS = [(0.25, "HIGH RISK"), (0.18, "MEDIUM RISK")]
RISK_ELSE = "LOW RISK"
SEGMENT_NAMES = ["High Risk (Grade D-G, DTI>25)", "Low Risk (Grade A-B, DTI<=20)", "Overall Portfolio"]
# VIF verdicts.
VIF_VERDICTS = [(10, "DROP (severe)"), (5, "WATCH (moderate)")]
VIF_ELSE = "OK"


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def exclude_keep_null(col: str | Column, values: Sequence) -> Column:
    """``~isin(values)`` with pandas semantics: null rows are kept."""
    c = _c(col)
    return c.isNull() | ~c.isin(list(values))


def recode(col: str | Column, mapping: Mapping, otherwise=None) -> Column:
    """Dictionary recode; unmapped and null inputs give ``otherwise`` (null)."""
    c = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(c == F.lit(k), F.lit(v)) if expr is None else expr.when(c == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def positive_flag(col: str | Column) -> Column:
    """``(x > 0).astype(int)``: a missing count gives 0."""
    return F.coalesce(_c(col) > 0, F.lit(False)).cast("int")


def clip_keep_null(col: str | Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """``Series.clip(lo, hi)``: missing stays missing (greatest/least would drop it)."""
    c = _c(col)
    out = F.when(c.isNull(), F.lit(None).cast("double"))
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(lo)
        out = out.when(c < lo_c, lo_c.cast("double"))
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else F.lit(hi)
        out = out.when(c > hi_c, hi_c.cast("double"))
    return out.otherwise(c.cast("double"))


def month_text_to_date(col: str | Column, fmt: str = "MMM-yyyy") -> Column:
    """``to_datetime(format='%b-%Y', errors='coerce')``: bad text gives null."""
    return F.try_to_date(_c(col), fmt)


def iso_date(col: str | Column) -> Column:
    """ISO date text to date; unparseable gives null."""
    return F.try_to_date(_c(col))


def years_until(col: str | Column, end: str = HISTORY_END_DATE) -> Column:
    """Days from ``col`` to a fixed date, divided by 365."""
    return F.datediff(F.to_date(F.lit(end)), _c(col)) / F.lit(365.0)


def percent_text(col: str | Column) -> Column:
    """``'25.5%'`` -> 25.5; unparseable -> null (``to_numeric(errors='coerce')``)."""
    txt = F.trim(F.regexp_replace(_c(col), "%", ""))
    val = txt.try_cast("double")
    return F.when(F.isnan(val), F.lit(None).cast("double")).otherwise(val)


def null_words_to_null(col: str | Column, words: Sequence[str] = NULL_WORDS) -> Column:
    """CSV text values that pandas reads as missing become null."""
    c = _c(col)
    return F.when(c.isin(list(words)), F.lit(None).cast("string")).otherwise(c)


def bucket(col: str | Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Ordered CASE binning: ``col < bounds[i]`` -> ``labels[i]``; else (null too) the last label."""
    assert len(labels) == len(bounds) + 1
    c = _c(col)
    expr = F.when(c < F.lit(bounds[0]), F.lit(labels[0]))
    for b, lab in zip(bounds[1:], labels[1:-1]):
        expr = expr.when(c < F.lit(b), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))


def half_open_band(col: str | Column, bands: Sequence[tuple[float, float, str]] = SCORE_BANDS) -> Column:
    """Named half-open bands ``[lo, hi)``; outside all bands -> null."""
    c = _c(col)
    expr = None
    for lo, hi, name in bands:
        cond = (c >= F.lit(lo)) & (c < F.lit(hi))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def at_least_label(col: str | Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose floor ``col >= floor`` holds (steps in descending floor order)."""
    c = _c(col)
    expr = None
    for floor, name in steps:
        expr = F.when(c >= F.lit(floor), F.lit(name)) if expr is None else expr.when(c >= F.lit(floor), F.lit(name))
    return expr.otherwise(F.lit(otherwise))


def above_label(col: str | Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """First label whose floor ``col > floor`` holds (strict; steps in descending order)."""
    c = _c(col)
    expr = None
    for floor, name in steps:
        expr = F.when(c > F.lit(floor), F.lit(name)) if expr is None else expr.when(c > F.lit(floor), F.lit(name))
    return expr.otherwise(F.lit(otherwise))


def three_tier(col: str | Column, low: float, high: float, names=("low", "medium", "high")) -> Column:
    """Colour / severity tiers: ``< low``, ``< high``, else (strict upper tiers)."""
    c = _c(col)
    return F.when(c < F.lit(low), F.lit(names[0])).when(c < F.lit(high), F.lit(names[1])).otherwise(F.lit(names[2]))


def apply_threshold(score: str | Column, threshold: float | Column) -> Column:
    """``(proba >= t).astype(int)``."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (_c(score) >= t).cast("int")


def threshold_grid_value(i: Column) -> Column:
    """Grid cut-off ``i / 100`` written so both engines produce the same double."""
    return i.cast("double") / F.lit(100.0)
