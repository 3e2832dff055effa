"""Registered statistical-test queries on the significance table
(engineered, null targets dropped, then imputed on the remaining rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.recode import VIF_ELSE, VIF_VERDICTS
from ..operators import features as fe
from ..operators import profile as prof
from ..operators import stats as st
from . import inputs
from .q_features import CAT, NUM, eng_sql
from .registry import query

SIG = eng_sql("target IS NOT NULL")


def significance_table(spark, sf_dir):
    """Engineered (cap over all rows), null targets dropped, imputed on the rest; written once."""
    def build():
        base = prof.engineer(inputs.loans(spark, sf_dir).select("id", *fe.PREP_FEATURES)).filter(F.col("target").isNotNull())
        num = prof.numeric_columns(base, ["id", "target"])
        cat = prof.string_columns(base, ["id", "target"])
        return fe.apply_imputer(base, fe.fit_imputer(base, num, cat))

    return inputs.materialise(spark, sf_dir, "significance", build)


_PB = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, COUNT(*) AS n, CORR({c}, target) AS r FROM imp" for c in NUM)


@query("point_biserial_r", oracle=SIG + f"""
SELECT feature, n, ROUND(r, 9) AS correlation, ROUND(r * SQRT((n - 2) / (1.0E0 - r * r)), 6) AS t_stat FROM ({_PB})""")
def point_biserial_r(spark, sf_dir):
    """T1 (r, t): correlation of each numeric feature with the target."""
    pb = st.point_biserial(significance_table(spark, sf_dir), NUM, with_p=False)
    return pb.select("feature", "n", F.round("correlation", 9).alias("correlation"), F.round("t_stat", 6).alias("t_stat"))


def _tail(rows: str, density: str, start: str) -> str:
    """Oracle text: Simpson's rule over ``density`` from ``start`` to 40 beyond, for each feature of ``rows``."""
    return (f"SELECT feature, SUM(CASE WHEN i = 0 OR i = 16000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density}) * 0.0025E0 / 3 AS area "
            f"FROM (SELECT {rows}.*, i, {start} + i * 0.0025E0 AS u FROM {rows}, (SELECT range AS i FROM range(16001))) GROUP BY feature")


_P_DIGITS = 6
_T_DENSITY = "EXP(LGAMMA((n - 1) / 2.0E0) - LGAMMA((n - 2) / 2.0E0) - 0.5E0 * LN((n - 2) * PI()) - (n - 1) / 2.0E0 * LN(1 + u * u / (n - 2)))"
_PB_P = f""",
pb AS (SELECT feature, n, r, r * SQRT((n - 2) / (1.0E0 - r * r)) AS t FROM ({_PB})),
pbp AS (SELECT pb.feature, n, r, t, LEAST(1.0E0, 2 * area) AS p FROM pb JOIN ({_tail("pb", _T_DENSITY, "ABS(t)")}) a ON a.feature = pb.feature)"""


def _rounded(df, digits):
    return df.select([F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("point_biserial", oracle=SIG.rstrip() + _PB_P + f"""
SELECT feature, n, ROUND(r, 9) AS correlation, ROUND(t, 6) AS t_stat, ROUND(p, {_P_DIGITS}) AS p_value,
       CASE WHEN p < 0.05E0 THEN 'YES' ELSE 'NO' END AS significant FROM pbp""")
def point_biserial(spark, sf_dir):
    """T1 with two-sided p-values (incomplete beta); the oracle integrates the t density."""
    return _rounded(st.point_biserial(significance_table(spark, sf_dir), NUM), {"correlation": 9, "t_stat": 6, "p_value": _P_DIGITS})


_MW_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, target FROM imp" for c in NUM)
_MW_MED = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, MEDIAN({c}) FILTER (WHERE target = 0) AS mp, MEDIAN({c}) FILTER (WHERE target = 1) AS md FROM imp" for c in NUM)
_MW = SIG.rstrip() + f""",
lg AS ({_MW_LONG}),
c AS (SELECT feature, value, CAST(COUNT(*) FILTER (WHERE target = 0) AS DOUBLE) AS c0,
             CAST(COUNT(*) FILTER (WHERE target = 1) AS DOUBLE) AS c1, CAST(COUNT(*) AS DOUBLE) AS t FROM lg WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, SUM(t) OVER (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING) - t + (t + 1.0E0) / 2.0E0 AS mr FROM c),
p AS (SELECT feature, SUM(c0) AS n0, SUM(c1) AS n1, SUM(c0 * mr) AS r0, SUM(t * t * t - t) AS tie FROM r GROUP BY feature),
u AS (SELECT *, r0 - n0 * (n0 + 1.0E0) / 2.0E0 AS u FROM p),
m AS ({_MW_MED})
SELECT u.feature, CAST(n0 AS BIGINT) AS n_paid, CAST(n1 AS BIGINT) AS n_default, u AS u_statistic, tie AS tie_term,
       ROUND((GREATEST(u, n0 * n1 - u) - n0 * n1 / 2.0E0 - 0.5E0)
             / SQRT(n0 * n1 / 12.0E0 * ((n0 + n1 + 1.0E0) - tie / ((n0 + n1) * (n0 + n1 - 1.0E0)))), 9) AS z,
       ROUND(mp, 9) AS median_paid, ROUND(md, 9) AS median_default
FROM u JOIN m ON u.feature = m.feature"""


@query("mann_whitney_u", oracle=_MW)
def mann_whitney_u(spark, sf_dir):
    """T2 (U, tie term, z, class medians) through bucketed mid-ranks."""
    mw = st.mann_whitney(significance_table(spark, sf_dir), NUM, with_p=False)
    return mw.select("feature", "n_paid", "n_default", "u_statistic", "tie_term", F.round("z", 9).alias("z"),
                     F.round("median_paid", 9).alias("median_paid"), F.round("median_default", 9).alias("median_default"))


_MW_CTES, _MW_ROWS = _MW.rsplit("\nSELECT u.feature", 1)
_MW_P = _MW_CTES + f""",
mw AS (SELECT u.feature{_MW_ROWS}),
mwp AS (SELECT mw.*, LEAST(1.0E0, 2 * area) AS p FROM mw JOIN ({_tail("mw", "EXP(-u * u / 2) / SQRT(2 * PI())", "z")}) a ON a.feature = mw.feature)"""


@query("mann_whitney", oracle=_MW_P + f"""
SELECT feature, n_paid, n_default, u_statistic, tie_term, z, median_paid, median_default, ROUND(p, {_P_DIGITS}) AS p_value,
       CASE WHEN p < 0.05E0 THEN 'YES' ELSE 'NO' END AS significant FROM mwp""")
def mann_whitney(spark, sf_dir):
    """T2 with two-sided p (erfc); the oracle integrates the normal density."""
    return _rounded(st.mann_whitney(significance_table(spark, sf_dir), NUM), {"z": 9, "median_paid": 9, "median_default": 9, "p_value": _P_DIGITS})


_CHI_LONG = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, target FROM imp" for c in CAT)
_CHI = SIG.rstrip() + f""",
lg AS ({_CHI_LONG}),
o AS (SELECT feature, value, target, CAST(COUNT(*) AS DOUBLE) AS o FROM lg WHERE value IS NOT NULL GROUP BY ALL),
rw AS (SELECT feature, value, SUM(o) AS row_n FROM o GROUP BY ALL),
cl AS (SELECT feature, target, SUM(o) AS col_n FROM o GROUP BY ALL),
tt AS (SELECT feature, SUM(o) AS n, COUNT(DISTINCT value) AS r, COUNT(DISTINCT target) AS c FROM o GROUP BY ALL),
cells AS (SELECT rw.feature, rw.value, cl.target, COALESCE(o.o, 0E0) AS o, row_n * col_n / n AS e, (r - 1) * (c - 1) AS dof
          FROM rw JOIN cl ON rw.feature = cl.feature JOIN tt ON rw.feature = tt.feature
          LEFT JOIN o ON o.feature = rw.feature AND o.value = rw.value AND o.target = cl.target)
SELECT feature, dof, ROUND(SUM(CASE WHEN dof = 1 THEN POW(ABS(o - e) - LEAST(0.5E0, ABS(o - e)), 2) ELSE (o - e) * (o - e) END / e), 6) AS chi2_stat
FROM cells GROUP BY feature, dof"""


@query("chi_square_stat", oracle=_CHI)
def chi_square_stat(spark, sf_dir):
    """T3 (statistic, dof) for the categorical features."""
    c = st.chi_square(significance_table(spark, sf_dir), CAT, with_p=False)
    return c.select("feature", "dof", F.round("chi2_stat", 6).alias("chi2_stat"))


_CHI_CTES, _CHI_ROWS = _CHI.rsplit("\nSELECT feature", 1)
# The density of the statistic's root, smooth for every number of degrees of freedom.
_CHI_DENSITY = "2 * EXP((dof - 1) * LN(GREATEST(u, 1e-300)) - u * u / 2 - dof / 2.0E0 * LN(2.0E0) - LGAMMA(dof / 2.0E0))"
_CHI_P = _CHI_CTES + f""",
ch AS (SELECT feature{_CHI_ROWS.replace("ROUND(SUM(", "SUM(").replace("/ e), 6)", "/ e)")}),
chp AS (SELECT ch.*, LEAST(1.0E0, area) AS p FROM ch JOIN ({_tail("ch", _CHI_DENSITY, "SQRT(chi2_stat)")}) a ON a.feature = ch.feature)"""


@query("chi_square", oracle=_CHI_P + f"""
SELECT feature, dof, ROUND(chi2_stat, 6) AS chi2_stat, ROUND(p, {_P_DIGITS}) AS p_value, CASE WHEN p < 0.05E0 THEN 'YES' ELSE 'NO' END AS significant FROM chp""")
def chi_square(spark, sf_dir):
    """T3 with p-values (regularized incomplete gamma); the oracle integrates the chi density."""
    return _rounded(st.chi_square(significance_table(spark, sf_dir), CAT), {"chi2_stat": 6, "p_value": _P_DIGITS})


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1:]]
_CORR = SIG + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, ROUND(CORR({a}, {b}), 9) AS correlation FROM imp" for a, b in _PAIRS)


@query("correlation_pairs", oracle=_CORR)
def correlation_pairs(spark, sf_dir):
    """T4: all pairwise correlations of the numeric features in one aggregate."""
    p = st.correlation_pairs(significance_table(spark, sf_dir), NUM)
    return p.withColumn("correlation", F.round("correlation", 9))


@query("high_correlation_pairs", oracle=SIG.rstrip() + ",\npairs AS ("
       + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, CORR({a}, {b}) AS correlation FROM imp" for a, b in _PAIRS)
       + ")\nSELECT feature_1, feature_2, ROUND(correlation, 3) AS correlation FROM pairs WHERE ABS(correlation) > 0.7")
def high_correlation_pairs(spark, sf_dir):
    """T5: pairs with |r| > 0.7."""
    return st.high_correlation_pairs(st.correlation_pairs(significance_table(spark, sf_dir), NUM))


@query("vif_pair", oracle=SIG + """
SELECT 'loan_amnt' AS feature, ROUND(SUM(loan_amnt * loan_amnt) * SUM(installment * installment)
       / (SUM(loan_amnt * loan_amnt) * SUM(installment * installment) - SUM(loan_amnt * installment) * SUM(loan_amnt * installment)), 2) AS VIF
FROM imp
UNION ALL SELECT 'installment', ROUND(SUM(loan_amnt * loan_amnt) * SUM(installment * installment)
       / (SUM(loan_amnt * loan_amnt) * SUM(installment * installment) - SUM(loan_amnt * installment) * SUM(loan_amnt * installment)), 2) FROM imp""")
def vif_pair(spark, sf_dir):
    """T6 for k = 2 (closed form in the oracle)."""
    return st.vif(significance_table(spark, sf_dir), ["loan_amnt", "installment"]).select("feature", "VIF")


_K = len(NUM)
_SCALE = ", ".join(f"SQRT(SUM({c} * {c})) AS {c}" for c in NUM)
_GRAM = ", ".join(f"SUM(imp.{a} * imp.{b}) / ANY_VALUE(sc.{a} * sc.{b})" for a in NUM for b in NUM)
_NAMES = ", ".join(f"'{c}'" for c in NUM)
# Sweeps every pivot of the scaled cross-product matrix, which leaves its inverse with the sign turned.
_VIF = SIG.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
sc AS (SELECT {_SCALE} FROM imp),
g AS (SELECT [{_GRAM}] AS m FROM imp, sc),
sweep(k, m) AS (SELECT 0, m FROM g UNION ALL
 SELECT k + 1, list_transform(range({_K * _K}), lambda x: CASE
   WHEN x // {_K} = k AND x % {_K} = k THEN -1.0E0 / m[k * {_K} + k + 1]
   WHEN x // {_K} = k OR x % {_K} = k THEN m[x + 1] / m[k * {_K} + k + 1]
   ELSE m[x + 1] - m[x // {_K} * {_K} + k + 1] * m[k * {_K} + x % {_K} + 1] / m[k * {_K} + k + 1] END)
 FROM sweep WHERE k < {_K}),
v AS (SELECT [{_NAMES}][i + 1] AS feature, ROUND(-m[i * {_K} + i + 1], 2) AS VIF FROM sweep, (SELECT range AS i FROM range({_K})) WHERE k = {_K})
SELECT feature, VIF, CASE {" ".join(f"WHEN VIF > {float(c)}E0 THEN '{name}'" for c, name in VIF_VERDICTS)} ELSE '{VIF_ELSE}' END AS verdict FROM v"""


@query("vif", oracle=_VIF)
def vif(spark, sf_dir):
    """Uncentred VIF of the 16 numeric features with verdicts (Gram matrix by one aggregate)."""
    return st.vif(significance_table(spark, sf_dir), NUM)


@query("feature_ranking", oracle=_MW_P + _PB_P + f"""
SELECT pbp.feature, ROUND(r, 4) AS pb_correlation, CASE WHEN pbp.p < 0.05E0 THEN 'YES' ELSE 'NO' END AS pb_significant,
       ROUND(mwp.p, {_P_DIGITS}) AS mw_pvalue, CASE WHEN mwp.p < 0.05E0 THEN 'YES' ELSE 'NO' END AS mw_significant
FROM pbp JOIN mwp ON mwp.feature = pbp.feature""")
def feature_ranking(spark, sf_dir):
    """Point-biserial and Mann-Whitney results joined, ordered by |r|."""
    t = significance_table(spark, sf_dir)
    return _rounded(st.feature_ranking(st.point_biserial(t, NUM), st.mann_whitney(t, NUM)), {"mw_pvalue": _P_DIGITS})
