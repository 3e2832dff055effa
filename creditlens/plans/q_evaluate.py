"""Registered evaluation queries on the deterministic score table (FIXTURES §B4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..operators import evaluate as ev
from ..operators import profile as prof
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

SC = oracle_views(("scored",))
SC2 = oracle_views(("scored", "scored_alt"))

RATES = """tp / (tp + fn) AS catch_rate, fp / (tn + fp) AS good_rejection,
       CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0E0 END AS precision,
       CASE WHEN tp > 0 THEN (5 * tp) / (5 * tp + 4 * fn + fp) ELSE 0E0 END AS f2"""


def _cm_sql(t: str, src: str = "scored", keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    g = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}COUNT(*) FILTER (WHERE target = 0 AND NOT score >= {t}) AS tn, COUNT(*) FILTER (WHERE target = 0 AND score >= {t}) AS fp,
       COUNT(*) FILTER (WHERE target = 1 AND NOT score >= {t}) AS fn, COUNT(*) FILTER (WHERE target = 1 AND score >= {t}) AS tp
FROM {src} WHERE target IS NOT NULL{g}"""


@query("confusion_at_half", oracle=SC.rstrip() + f""",
cm AS ({_cm_sql('0.5E0')})
SELECT tn, fp, fn, tp, {RATES} FROM cm""")
def confusion_at_half(spark, sf_dir):
    """Confusion counts, catch and good-rejection (the operating point) at 0.5."""
    return ev.confusion(inputs.scored(spark, sf_dir), 0.5)


_COLLAPSED = """c AS (SELECT score, COUNT(*) FILTER (WHERE target = 1) AS n_pos, COUNT(*) FILTER (WHERE target = 0) AS n_neg
      FROM scored WHERE target IS NOT NULL AND score IS NOT NULL GROUP BY score),
t AS (SELECT SUM(n_pos) AS P, SUM(n_neg) AS N FROM c),
cum AS (SELECT c.*, SUM(n_neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - n_neg AS neg_below,
               SUM(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
               SUM(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps FROM c)"""


@query("auc_exact", oracle=SC.rstrip() + f""",
{_COLLAPSED}
SELECT SUM(n_pos * neg_below + n_pos * n_neg / 2.0E0) / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) AS auc, P AS n_pos, N AS n_neg
FROM cum, t GROUP BY P, N""")
def auc_exact(spark, sf_dir):
    """Exact ROC-AUC with ties through the bucketed prefix sum."""
    return ev.auc(inputs.scored(spark, sf_dir))


@query("roc_curve", oracle=SC.rstrip() + f""",
{_COLLAPSED}
SELECT score AS threshold, fps / N AS fpr, tps / P AS tpr FROM cum, t
UNION ALL SELECT 'Infinity'::DOUBLE, 0E0, 0E0""")
def roc_curve(spark, sf_dir):
    return ev.roc_curve(inputs.scored(spark, sf_dir))


@query("roc_curve_thinned", oracle=SC.rstrip() + f""",
{_COLLAPSED},
nb AS (SELECT cum.*, LAG(n_pos) OVER (ORDER BY score) AS pp, LAG(n_neg) OVER (ORDER BY score) AS pn,
              LAG(score) OVER (ORDER BY score) AS ps, MAX(score) OVER () AS mx FROM cum)
SELECT score AS threshold, fps / N AS fpr, tps / P AS tpr FROM nb, t
WHERE NOT (score < mx AND ps IS NOT NULL AND pp = n_pos AND pn = n_neg)
UNION ALL SELECT 'Infinity'::DOUBLE, 0E0, 0E0""")
def roc_curve_thinned(spark, sf_dir):
    """E4 with collinear points dropped (bucketed neighbour lookup, no global window)."""
    return ev.roc_curve_thinned(inputs.scored(spark, sf_dir))


_PR = SC.rstrip() + f""",
{_COLLAPSED},
pr AS (SELECT score AS threshold, tps / (tps + fps) AS precision, tps / P AS recall FROM cum, t
       UNION ALL SELECT NULL, 1E0, 0E0),
prf AS (SELECT *, CASE WHEN 4.0E0 * precision + recall > 0 THEN 5.0E0 * precision * recall / (4.0E0 * precision + recall) ELSE 0E0 END AS f2 FROM pr)
"""


@query("pr_curve", oracle=_PR + "SELECT * FROM prf")
def pr_curve(spark, sf_dir):
    """E5: precision-recall points with the final (1, 0) point and F2."""
    return ev.pr_curve(inputs.scored(spark, sf_dir))


_F2 = _PR.rstrip() + """,
best AS (SELECT * FROM prf WHERE threshold IS NOT NULL ORDER BY f2 DESC, threshold ASC LIMIT 1)
"""


@query("f2_threshold", oracle=_F2 + "SELECT FLOOR(threshold * 100.0E0 + 0.5E0) / 100.0E0 AS threshold, threshold AS raw_threshold, f2, precision, recall FROM best")
def f2_threshold(spark, sf_dir):
    """F2-optimal cut-off over every distinct score."""
    return ev.f2_threshold(inputs.scored(spark, sf_dir))


_SWEEP = SC.rstrip() + """,
g AS (SELECT CAST(range AS INT) AS i FROM range(10, 90)),
cm AS (SELECT g.i / 100.0E0 AS threshold,
              COUNT(*) FILTER (WHERE target = 1 AND score >= g.i / 100.0E0) AS tp,
              COUNT(*) FILTER (WHERE target = 0 AND score >= g.i / 100.0E0) AS fp,
              COUNT(*) FILTER (WHERE target = 0 AND NOT score >= g.i / 100.0E0) AS tn,
              COUNT(*) FILTER (WHERE target = 1 AND NOT score >= g.i / 100.0E0) AS fn
       FROM g CROSS JOIN scored WHERE target IS NOT NULL GROUP BY g.i),
""" + f"sw AS (SELECT threshold, tp, fp, tn, fn, {RATES} FROM cm)\n"


@query("threshold_sweep", oracle=_SWEEP + "SELECT * FROM sw")
def threshold_sweep(spark, sf_dir):
    """Catch, good-rejection, precision and F2 at 80 cut-offs in one pass."""
    return ev.sweep(inputs.scored(spark, sf_dir))


@query("constrained_threshold", oracle=_SWEEP.rstrip() + """,
b AS (SELECT catch_rate * 1.3E0 AS target_catch, good_rejection + 0.1E0 AS max_good_rejection FROM sw WHERE threshold = 0.5E0),
best AS (SELECT threshold, 'constraint' AS chosen_by FROM sw, b
         WHERE catch_rate >= target_catch AND good_rejection <= max_good_rejection ORDER BY good_rejection, threshold LIMIT 1),
pick AS (SELECT * FROM best UNION ALL SELECT 0.4E0, 'fallback' WHERE NOT EXISTS (SELECT 1 FROM best))
SELECT pick.threshold, chosen_by, sw.catch_rate, sw.good_rejection, sw.f2, b.target_catch, b.max_good_rejection
FROM pick LEFT JOIN sw ON pick.threshold = sw.threshold CROSS JOIN b""")
def constrained_threshold(spark, sf_dir):
    """The business-constraint cut-off with its fallback."""
    return ev.constrained_threshold(ev.sweep(inputs.scored(spark, sf_dir)))


@query("closest_options", oracle=_SWEEP + """
SELECT *, catch_rate - good_rejection AS score FROM sw ORDER BY score DESC, threshold LIMIT 5""")
def closest_options(spark, sf_dir):
    return ev.closest_options(ev.sweep(inputs.scored(spark, sf_dir)))


def _at_f2(spark, sf_dir):
    sc = inputs.scored(spark, sf_dir)
    t = ev.f2_threshold(sc).select(F.col("threshold").alias("_t"))
    return ev.confusion(with_scalars(sc, t), F.col("_t"))


_AT_F2 = _F2.rstrip() + """,
cm AS (SELECT COUNT(*) FILTER (WHERE target = 0 AND NOT score >= t) AS tn, COUNT(*) FILTER (WHERE target = 0 AND score >= t) AS fp,
              COUNT(*) FILTER (WHERE target = 1 AND NOT score >= t) AS fn, COUNT(*) FILTER (WHERE target = 1 AND score >= t) AS tp
       FROM scored, (SELECT FLOOR(threshold * 100.0E0 + 0.5E0) / 100.0E0 AS t FROM best) bt WHERE target IS NOT NULL)
"""


@query("business_impact", oracle=_AT_F2 + """
SELECT tn, fp, fn, tp, tp + fp + tn + fn AS total, tn + fn AS approved, tp + fp AS rejected, tp + fn AS defaults,
       tp AS defaults_caught, fn AS defaults_missed, tn + fp AS good_borrowers,
       (tp + fn) / (tp + fp + tn + fn) AS default_rate_no_model,
       CASE WHEN tn + fn > 0 THEN fn / (tn + fn) ELSE 0E0 END AS default_rate_approved,
       ((tp + fn) / (tp + fp + tn + fn) - CASE WHEN tn + fn > 0 THEN fn / (tn + fn) ELSE 0E0 END) / ((tp + fn) / (tp + fp + tn + fn)) AS default_rate_reduction,
       tp / (tp + fn) AS catch_rate, fp / (tn + fp) AS good_rejection, tn / (tn + fp) AS good_approved_rate
FROM cm""")
def business_impact(spark, sf_dir):
    """Impact at the F2-optimal (rounded, re-applied) cut-off."""
    return ev.business_impact(_at_f2(spark, sf_dir))


def _f1(p, r):
    return f"CASE WHEN {p} + {r} > 0 THEN 2.0E0 * {p} * {r} / ({p} + {r}) ELSE 0E0 END"


_P0, _R0 = "CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0E0 END", "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0E0 END"
_P1, _R1 = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0E0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0E0 END"


@query("classification_report", oracle=_AT_F2.rstrip() + f""",
m AS (SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp FROM cm),
v AS (SELECT {_P0} AS p0, {_R0} AS r0, tn + fp AS s0, {_P1} AS p1, {_R1} AS r1, tp + fn AS s1, tp, tn FROM m),
f AS (SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1 FROM v)
SELECT 'Fully Paid' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT 'Default', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / (s0 + s1), s0 + s1 FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f""")
def classification_report(spark, sf_dir):
    """E6 at the F2-optimal cut-off."""
    return ev.classification_report(_at_f2(spark, sf_dir))


_SDIST = SC.rstrip() + """,
d AS (SELECT target, score AS x FROM scored WHERE score IS NOT NULL AND target IS NOT NULL),
r AS (SELECT target, MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, (MAX(x) - MIN(x)) / 50.0E0 AS w FROM d GROUP BY target),
c AS (SELECT d.target, CASE WHEN r.hi = r.lo THEN 0 ELSE LEAST(49, CAST(FLOOR((d.x - r.lo) / (r.hi - r.lo) * 50.0E0) AS INT)) END AS bin,
             COUNT(*) AS cnt FROM d JOIN r ON d.target = r.target GROUP BY ALL),
b AS (SELECT r.target, g.bin, r.lo, r.w, r.n FROM r, (SELECT CAST(range AS INT) AS bin FROM range(50)) g)
SELECT b.target, b.bin, b.lo + b.bin * b.w AS bin_lo, b.lo + (b.bin + 1) * b.w AS bin_hi,
       COALESCE(c.cnt, 0) AS count, COALESCE(c.cnt, 0) / (b.n * b.w) AS density
FROM b LEFT JOIN c ON b.target = c.target AND b.bin = c.bin"""


@query("score_distribution", oracle=_SDIST)
def score_distribution(spark, sf_dir):
    """50-bin density histogram of the score per class."""
    return prof.histogram(inputs.scored(spark, sf_dir), "score", 50, by="target", density=True)


@query("score_class_means", oracle=SC + """
SELECT target, ROUND(AVG(score), 9) AS mean_score, ROUND(MEDIAN(score), 9) AS median_score, COUNT(*) AS n
FROM scored WHERE target IS NOT NULL GROUP BY target""")
def score_class_means(spark, sf_dir):
    m = ev.score_means(inputs.scored(spark, sf_dir))
    return m.select("target", F.round("mean_score", 9).alias("mean_score"), F.round("median_score", 9).alias("median_score"), "n")


def _two_models(spark, sf_dir):
    a = inputs.scored(spark, sf_dir).withColumn("model", F.lit("score_a"))
    b = inputs.scored(spark, sf_dir, alt=True).withColumn("model", F.lit("score_b"))
    return a.unionByName(b)


_TWO = SC2.rstrip() + """,
scores AS (SELECT 'score_a' AS model, * FROM scored UNION ALL SELECT 'score_b' AS model, * FROM scored_alt),
c AS (SELECT model, score, COUNT(*) FILTER (WHERE target = 1) AS n_pos, COUNT(*) FILTER (WHERE target = 0) AS n_neg
      FROM scores WHERE target IS NOT NULL GROUP BY model, score),
cum AS (SELECT c.*, SUM(n_neg) OVER (PARTITION BY model ORDER BY score ROWS UNBOUNDED PRECEDING) - n_neg AS neg_below,
               SUM(n_pos) OVER (PARTITION BY model) AS P, SUM(n_neg) OVER (PARTITION BY model) AS N FROM c),
a AS (SELECT model, SUM(n_pos * neg_below + n_pos * n_neg / 2.0E0) / (CAST(MAX(P) AS DOUBLE) * CAST(MAX(N) AS DOUBLE)) AS auc FROM cum GROUP BY model),
""" + f"cm AS ({_cm_sql('0.5E0', 'scores', 'model')})\n"


@query("model_comparison", oracle=_TWO + f"""
SELECT cm.model, 0.5E0 AS threshold, a.auc, tn, fp, fn, tp, {RATES} FROM cm JOIN a ON cm.model = a.model""")
def model_comparison(spark, sf_dir):
    """AUC, catch and good-rejection per model, all series in one job."""
    return ev.evaluate(_two_models(spark, sf_dir), 0.5, keys=["model"])
