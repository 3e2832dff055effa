"""Registered feature-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array

from ..functions.recode import DROP_STATUSES
from ..operators import features as fe
from ..operators import preparation as pr
from ..operators import profile as prof
from ..session import scratch_path
from ..sources import fixtures
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

LOANS = oracle_views(("loans",))

NUM = ["dti", "annual_inc", "loan_amnt", "int_rate", "installment", "grade", "emp_length", "open_acc", "revol_bal",
       "revol_util", "total_acc", "mort_acc", "delinq_2yrs", "inq_last_6mths", "credit_history_years", "has_derogatory"]
CAT = ["purpose", "home_ownership", "verification_status"]
# Levels present in the fixture (sorted); the first of each is dropped by the encoder.
LEVELS = {
    "purpose": ["automobile", "building", "furniture", "household", "machinery", "small_business", "wedding"],
    "home_ownership": ["ANY", "MORTGAGE", "OWN", "RENT"],
    "verification_status": ["Not Verified", "Source Verified", "Verified"],
}
DUMMIES = [(c, v) for c in CAT for v in LEVELS[c][1:]]

def eng_sql(fit_where: str = "TRUE") -> str:
    """Oracle CTEs: engineered table ``eng`` (cap over all rows), the fit scope
    ``engf`` and the imputed table ``imp`` over that scope."""
    return LOANS.rstrip() + """,
cap AS (SELECT QUANTILE_CONT(annual_inc, 0.99) AS c FROM loans),
eng AS (SELECT CAST(id AS VARCHAR) AS id, id AS idn, dti, purpose,
       CASE WHEN annual_inc IS NULL THEN NULL WHEN annual_inc < 0 THEN 0E0 WHEN annual_inc > cap.c THEN cap.c ELSE annual_inc END AS annual_inc,
       loan_amnt, int_rate, installment, CAST(NULLIF(STRPOS('ABCDEFG', grade), 0) AS DOUBLE) AS grade,
       CAST(CASE emp_length WHEN '< 1 year' THEN 0 WHEN '1 year' THEN 1 WHEN '10+ years' THEN 10
            ELSE TRY_CAST(SUBSTR(emp_length, 1, 1) AS INT) END AS DOUBLE) AS emp_length,
       home_ownership, verification_status, open_acc, revol_bal, revol_util, total_acc, mort_acc, delinq_2yrs, inq_last_6mths, target,
       DATE_DIFF('day', earliest_cr_date, DATE '2018-12-31') / 365.0E0 AS credit_history_years,
       CASE WHEN pub_rec > 0 THEN 1 ELSE 0 END AS has_derogatory
FROM loans, cap),
engf AS (SELECT * FROM eng WHERE """ + fit_where + """),
med AS (SELECT """ + ", ".join(f"MEDIAN({c}) AS {c}" for c in NUM) + """ FROM engf),
""" + ",\n".join(
        f"mode_{c} AS (SELECT v AS {c} FROM (SELECT {c} AS v, COUNT(*) AS n FROM engf WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v LIMIT 1)"
        for c in CAT) + """,
imp AS (SELECT engf.id, engf.idn, engf.target, """ + ", ".join(f"CAST(COALESCE(engf.{c}, med.{c}) AS DOUBLE) AS {c}" for c in NUM) + ", " + \
        ", ".join(f"COALESCE(engf.{c}, mode_{c}.{c}) AS {c}" for c in CAT) + """
    FROM engf, med, """ + ", ".join(f"mode_{c}" for c in CAT) + """)
"""


_ENG = eng_sql()


@query("imputed_features", oracle=_ENG + "SELECT id, target, " + ", ".join(f"ROUND({c}, 9) AS {c}" for c in NUM) + ", " + ", ".join(CAT) + " FROM imp")
def imputed_features(spark, sf_dir):
    """engineered features, medians for numbers and modes for text (fit on all rows)."""
    base = prof.engineer(inputs.loans(spark, sf_dir).select("id", *[c for c in fe.PREP_FEATURES]))
    num = prof.numeric_columns(base, ["id", "target"])
    cat = prof.string_columns(base, ["id", "target"])
    out = fe.apply_imputer(base, fe.fit_imputer(base, num, cat))
    return out.select("id", "target", *[F.round(c, 9).alias(c) for c in NUM], *CAT)


_ONEHOT_SQL = ", ".join(f"CAST({c} = '{v}' AS INTEGER) AS \"{c}_{v}\"" for c, v in DUMMIES)


@query("one_hot_features", oracle=_ENG + f"SELECT id, {_ONEHOT_SQL} FROM imp")
def one_hot_features(spark, sf_dir):
    """dummies with the alphabetically first level dropped."""
    base = prof.engineer(inputs.loans(spark, sf_dir).select("id", *fe.PREP_FEATURES))
    cat = prof.string_columns(base, ["id", "target"])
    imp = fe.apply_imputer(base, fe.fit_imputer(base, [], cat))
    enc = fe.apply_one_hot(imp.select("id", *cat), fe.fit_levels(imp, cat))
    return enc


_SPLIT = LOANS.rstrip() + f""",
h AS (SELECT CAST(id AS VARCHAR) AS id, id AS idn, target, ((id % {fe.HASH_M}) * {fe.HASH_A}) % {fe.HASH_M} AS hv FROM loans WHERE target IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY hv, idn) AS rn, COUNT(*) OVER (PARTITION BY target) AS nc FROM h)
"""


@query("stratified_split", oracle=_SPLIT + "SELECT id, target, rn <= FLOOR(0.2E0 * nc + 0.5E0) AS is_test FROM r")
def stratified_split(spark, sf_dir):
    """exact 80/20 split per class on a hashed id order."""
    return fe.stratified_split(inputs.loans(spark, sf_dir).select("id", "target"), "target", 0.2, "id")


@query("split_class_shares", oracle=_SPLIT + """
SELECT rn <= FLOOR(0.2E0 * nc + 0.5E0) AS is_test, target, COUNT(*) AS n FROM r GROUP BY ALL""")
def split_class_shares(spark, sf_dir):
    """Class counts on each side of the split (shares preserved)."""
    s = fe.stratified_split(inputs.loans(spark, sf_dir).select("id", "target"), "target", 0.2, "id")
    return s.groupBy("is_test", "target").agg(F.count(F.lit(1)).alias("n"))


_ALL = NUM + [f"{c}_{v}" for c, v in DUMMIES]
_PREP = _ENG.rstrip() + ",\n" + f"""enc AS (SELECT imp.*, {_ONEHOT_SQL} FROM imp),
h AS (SELECT enc.*, ((idn % {fe.HASH_M}) * {fe.HASH_A}) % {fe.HASH_M} AS hv FROM enc WHERE target IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY hv, idn) AS rn, COUNT(*) OVER (PARTITION BY target) AS nc FROM h),
s AS (SELECT *, rn <= FLOOR(0.2E0 * nc + 0.5E0) AS is_test FROM r),
st AS (SELECT """ + ", ".join(
    f'AVG("{c}") AS "mu_{c}", CASE WHEN STDDEV_POP("{c}") = 0 OR STDDEV_POP("{c}") IS NULL THEN 1E0 ELSE STDDEV_POP("{c}") END AS "sd_{c}", '
    f'COUNT(DISTINCT "{c}") AS "nd_{c}"' for c in _ALL) + """ FROM s WHERE NOT is_test)
SELECT id, target, is_test, """ + ", ".join(
    f'ROUND(CASE WHEN "nd_{c}" > 2 THEN ("{c}" - "mu_{c}") / "sd_{c}" ELSE "{c}" END, 9) AS "{c}"' for c in _ALL) + """
FROM s, st"""


@query("prepared_features", oracle=_PREP)
def prepared_features(spark, sf_dir):
    """the whole preparation; scaling fitted on the training side only."""
    prepared, _ = fe.prepare(inputs.loans(spark, sf_dir))
    return prepared.select("id", "target", "is_test", *[F.round(F.col(f"`{c}`").cast("double"), 9).alias(c) for c in _ALL])


_FITTED: dict = {}


def _saved_preparation(spark, sf_dir) -> PipelineModel:
    """The preparation fitted on the labelled loans, saved once a session and loaded again."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = scratch_path(spark, "preparation")
        pr.fit_preparation(inputs.loans(spark, sf_dir)).write().save(_FITTED[key])
    return PipelineModel.load(_FITTED[key])


# The oracle's fitted state as above, applied to the loans whose status says nothing yet.
_LEFT = ", ".join(f"'{s}'" for s in DROP_STATUSES)
_NEW = _PREP[: _PREP.rindex("SELECT id, target, is_test")].rstrip() + f""",
fresh AS (SELECT * FROM raw_loans WHERE loan_status IN ({_LEFT})),
neng AS (SELECT CAST(id AS VARCHAR) AS id, dti, purpose,
       CASE WHEN annual_inc IS NULL THEN NULL WHEN annual_inc < 0 THEN 0E0 WHEN annual_inc > cap.c THEN cap.c ELSE annual_inc END AS annual_inc,
       loan_amnt, int_rate, installment, CAST(NULLIF(STRPOS('ABCDEFG', grade), 0) AS DOUBLE) AS grade,
       CAST(CASE emp_length WHEN '< 1 year' THEN 0 WHEN '1 year' THEN 1 WHEN '10+ years' THEN 10
            ELSE TRY_CAST(SUBSTR(emp_length, 1, 1) AS INT) END AS DOUBLE) AS emp_length,
       home_ownership, verification_status, open_acc, revol_bal, revol_util, total_acc, mort_acc, delinq_2yrs, inq_last_6mths,
       DATE_DIFF('day', earliest_cr_date, DATE '2018-12-31') / 365.0E0 AS credit_history_years,
       CASE WHEN pub_rec > 0 THEN 1 ELSE 0 END AS has_derogatory FROM fresh, cap),
nimp AS (SELECT neng.id, """ + ", ".join(f"CAST(COALESCE(neng.{c}, med.{c}) AS DOUBLE) AS {c}" for c in NUM) + ", " + \
    ", ".join(f"COALESCE(neng.{c}, mode_{c}.{c}) AS {c}" for c in CAT) + " FROM neng, med, " + ", ".join(f"mode_{c}" for c in CAT) + f"""),
nenc AS (SELECT nimp.*, {_ONEHOT_SQL} FROM nimp)
SELECT id, """ + ", ".join(f'ROUND(CASE WHEN "nd_{c}" > 2 THEN ("{c}" - "mu_{c}") / "sd_{c}" ELSE "{c}" END, 9) AS "{c}"' for c in _ALL) + " FROM nenc, st"


@query("prepare_apply_new_rows", oracle=_NEW)
def prepare_apply_new_rows(spark, sf_dir):
    """The saved and loaded preparation on raw rows that it was not fitted on (open loans)."""
    model = _saved_preparation(spark, sf_dir)
    fresh = fixtures.raw_loans(spark, sf_dir).filter(F.col("loan_status").isin(*DROP_STATUSES))
    out = model.transform(fresh.select("id", *[c for c in fe.PREP_FEATURES if c != "target"]))
    names = model.stages[-1].fitted["features"]
    return out.select("id", vector_to_array("features").alias("v")).select("id", *[F.round(F.col("v")[i], 9).alias(c) for i, c in enumerate(names)])


@query("scaler_roundtrip", oracle=_PREP[: _PREP.rindex("SELECT id, target, is_test")] + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, ROUND("mu_{c}", 9) AS mean, ROUND("sd_{c}", 9) AS deviation FROM st WHERE "nd_{c}" > 2""" for c in _ALL))
def scaler_roundtrip(spark, sf_dir):
    """What a saved and loaded scaler scales by."""
    path = scratch_path(spark, "scaler")
    _saved_preparation(spark, sf_dir).stages[3].write().save(path)
    fitted = pr.PopulationScaler.load(path).fitted
    rows = [(c, fitted["mean"][c], fitted["std"][c]) for c in fitted["mean"]]
    out = spark.createDataFrame(rows, "feature string, mean double, deviation double")
    return out.select("feature", F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query("stratified_split_text_ids", oracle=LOANS.rstrip() + """,
t AS (SELECT 'loan-' || CAST(id AS VARCHAR) AS id, target FROM loans WHERE target IS NOT NULL),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY target ORDER BY md5(id), id) AS rn, COUNT(*) OVER (PARTITION BY target) AS nc FROM t)
SELECT id, target, rn <= FLOOR(0.2E0 * nc + 0.5E0) AS is_test FROM r""")
def stratified_split_text_ids(spark, sf_dir):
    """F5 on text ids, by radix selection over a hash of the text."""
    loans = inputs.loans(spark, sf_dir).select(F.concat(F.lit("loan-"), F.col("id").cast("string")).alias("id"), "target")
    return fe.radix_split(loans, "target", 0.2, "id")


@query("class_weights", oracle=LOANS + """
SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE target = 1) AS n_pos, COUNT(*) FILTER (WHERE target = 0) AS n_neg,
       COUNT(*) / (2.0E0 * COUNT(*) FILTER (WHERE target = 0)) AS weight_neg_balanced,
       COUNT(*) / (2.0E0 * COUNT(*) FILTER (WHERE target = 1)) AS weight_pos_balanced,
       COUNT(*) FILTER (WHERE target = 0) / COUNT(*) FILTER (WHERE target = 1) AS scale_pos_weight
FROM loans WHERE target IS NOT NULL""")
def class_weights(spark, sf_dir):
    """M3/M4: balanced class weights and the positive-class weight."""
    return fe.class_weights(inputs.loans(spark, sf_dir))


@query("nulls_after_imputation", oracle=_ENG + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count, COUNT(*) AS row_count FROM imp" for c in NUM + CAT))
def nulls_after_imputation(spark, sf_dir):
    """A1 after filling: every feature column has zero missing values left."""
    base = prof.engineer(inputs.loans(spark, sf_dir).select("id", *fe.PREP_FEATURES))
    num = prof.numeric_columns(base, ["id", "target"])
    cat = prof.string_columns(base, ["id", "target"])
    return prof.null_audit(fe.apply_imputer(base, fe.fit_imputer(base, num, cat)), NUM + CAT)
