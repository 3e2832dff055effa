"""Tree-model explanations (path-dependent SHAP values) as a distributed job.

The fitted ensemble is read through Spark ML persistence (its node table),
turned into per-leaf tables on the driver — their size is bounded by the
model, never by the data — and broadcast.  Rows are explained in Arrow
batches by ``mapInPandas``: every leaf contributes, for each distinct
feature on its path,

    v_leaf * (o_f - r_f) * Σ_{S ⊆ D\\f} |S|!(d-|S|-1)!/d! Π_{j∈S} o_j Π_{j∉S} r_j

where D is the leaf's set of d path features, o_j tells whether the row
satisfies all of the path's conditions on feature j (an interval test) and
r_j is the product of the cover ratios of the path's splits on j.  The sum
over subsets is the coefficient series of Π_{j≠f}(r_j + o_j z) weighted by
k!(d-k-1)!/d!.

A leaf's attributions depend on a row only through its d bits o_j, so for leaves of up to
``TABLED`` path features all 2^d x d attributions are computed once, on the driver. A row
then costs one interval test and one look-up per path feature: its values are replaced by
their ranks among the model's thresholds, bits are compared on small integers, and the
looked-up attributions are summed by feature. Deeper leaves are evaluated row by row.

Boosted trees explain the class-1 log-odds 2F (Spark's GBT probability is
1/(1+exp(-2F))); forests explain the class-1 probability.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import scalar_values
from ..session import scratch_path
from .prefix import exact_quantiles, quantile_bins


# ---------------------------------------------------------------------------
# Model -> leaf tables
# ---------------------------------------------------------------------------
def _read_nodes(spark: SparkSession, model) -> pd.DataFrame:
    path = scratch_path(spark, "tree-model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories")
    return nodes.toPandas()  # model-sized: trees x nodes


def leaf_tables(spark: SparkSession, model, kind: str | None = None) -> dict:
    """Per-leaf arrays: value (already multiplied by tree weight), path features,
    interval bounds and cover ratios; plus the base value."""
    kind = kind or ("gbt" if type(model).__name__.startswith("GBT") else "rf")
    nodes = _read_nodes(spark, model)
    if kind == "gbt":
        weights = [2.0 * float(w) for w in model.treeWeights]  # log-odds = 2F
    else:
        n_trees = model.getNumTrees if isinstance(model.getNumTrees, int) else model.getNumTrees()
        weights = [1.0 / n_trees] * n_trees
    leaves = []
    base = 0.0
    for tid, t in nodes.groupby("treeID"):
        t = t.set_index("id")
        w = weights[int(tid)]

        def cover(i):
            return float(sum(t.at[i, "impurityStats"])) if kind == "rf" else float(t.at[i, "impurityStats"][0])

        def value(i):
            if kind == "rf":
                s = t.at[i, "impurityStats"]
                return float(s[1]) / float(sum(s)) if sum(s) > 0 else 0.0
            return float(t.at[i, "prediction"])

        root = int(t.index.min()) if 0 not in t.index else 0
        root_cover = cover(root)
        stack = [(root, {})]
        while stack:
            i, path = stack.pop()
            left, right = int(t.at[i, "leftChild"]), int(t.at[i, "rightChild"])
            if left < 0:
                v = w * value(i)
                base += v * cover(i) / root_cover
                feats = sorted(path)
                leaves.append((v, feats, [path[f] for f in feats]))
                continue
            if int(t.at[i, "numCategories"]) >= 0:
                raise NotImplementedError("categorical splits are not supported; encode as numeric columns")
            f = int(t.at[i, "featureIndex"])
            thr = float(t.at[i, "leftCategoriesOrThreshold"][0])
            c = cover(i)
            for child, go_left in ((left, True), (right, False)):
                lo, hi, r = path.get(f, (-math.inf, math.inf, 1.0))
                lo2, hi2 = (lo, min(hi, thr)) if go_left else (max(lo, thr), hi)
                ratio = cover(child) / c if c > 0 else 0.0
                p2 = dict(path)
                p2[f] = (lo2, hi2, r * ratio)
                stack.append((child, p2))
    depth = max((len(fs) for _, fs, _ in leaves), default=1) or 1
    n = len(leaves)
    feat = np.full((n, depth), -1, dtype=np.int64)
    lo = np.full((n, depth), -np.inf)
    hi = np.full((n, depth), np.inf)
    r = np.ones((n, depth))
    val = np.zeros(n)
    dlen = np.zeros(n, dtype=np.int64)
    for k, (v, fs, bounds) in enumerate(leaves):
        val[k], dlen[k] = v, len(fs)
        for j, (f, (a, b, rr)) in enumerate(zip(fs, bounds)):
            feat[k, j], lo[k, j], hi[k, j], r[k, j] = f, a, b, rr
    # Shapley weights k!(d-k-1)!/d! per leaf, k < d.
    wts = np.zeros((n, depth))
    for k in range(n):
        d = dlen[k]
        for s in range(d):
            wts[k, s] = math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)
    return {"feat": feat, "lo": lo, "hi": hi, "r": r, "val": val, "dlen": dlen, "w": wts, "base": base, "kind": kind,
            "depth": depth}


# ---------------------------------------------------------------------------
# Attributions for a batch of rows
# ---------------------------------------------------------------------------
#: Path features up to which a leaf's attributions are tabled, and leaves and rows looked up at once.
TABLED = 8
_LEAVES, _ROWS = 512, 1024


def _attributions(r: np.ndarray, val: np.ndarray) -> np.ndarray:
    """(leaves, 2^d, d) attributions for every pattern of path features that a row satisfies."""
    n, d = r.shape
    bits = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    weights = np.array([math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)])
    out = np.empty((n, 1 << d, d))
    for f in range(d):
        p = np.zeros((n, 1 << d, d))
        p[:, :, 0] = 1.0
        for j in range(d):
            if j != f:
                more = np.zeros_like(p)
                more[:, :, 1:] = p[:, :, :-1] * bits[None, :, j, None]
                p = p * r[:, None, j, None] + more
        out[:, :, f] = val[:, None] * (bits[None, :, f] - r[:, None, f]) * (p @ weights)
    return out


def pattern_tables(t: dict) -> dict:
    """Leaf tables as look-up tables: per feature its sorted thresholds, per number of path
    features the leaves' features, bounds as ranks of thresholds, and attributions by pattern."""
    real = t["feat"] >= 0
    cuts = {}
    for f in np.unique(t["feat"][real]).tolist():
        own = np.concatenate([t[k][t["feat"] == f] for k in ("lo", "hi")])
        cuts[f] = np.unique(own[np.isfinite(own)])
    groups = []
    for d in np.unique(t["dlen"]).tolist():
        rows = np.flatnonzero(t["dlen"] == d)
        if not 0 < d <= TABLED:
            continue
        feat, lo, hi = (t[k][rows, :d] for k in ("feat", "lo", "hi"))
        low, high = np.full(feat.shape, -1, np.int32), np.full(feat.shape, np.iinfo(np.int32).max, np.int32)
        for f, own in cuts.items():
            a, b = (feat == f) & np.isfinite(lo), (feat == f) & np.isfinite(hi)
            low[a], high[b] = np.searchsorted(own, lo[a]), np.searchsorted(own, hi[b])
        groups.append({"feat": feat, "low": low, "high": high, "table": _attributions(t["r"][rows, :d], t["val"][rows])})
    deep = np.flatnonzero(t["dlen"] > TABLED)
    dense = {**t, **{k: t[k][deep] for k in LEAF_ARRAYS}} if len(deep) else None
    return {"cuts": cuts, "groups": groups, "dense": dense, "base": t["base"]}


def shap_batch(x: np.ndarray, p: dict, n_features: int) -> np.ndarray:
    """SHAP values (rows x features) of a NumPy batch against pattern tables ``p``."""
    phi = np.zeros((n_features, len(x)))
    rank = np.zeros((n_features, len(x)), np.int32)  # thresholds below the value; no interval holds a missing value
    for f, own in p["cuts"].items():
        rank[f] = np.where(np.isnan(x[:, f]), -1, np.searchsorted(own, x[:, f]))
    for g in p["groups"]:
        n, d = g["feat"].shape
        for a in range(0, n, _LEAVES):
            feat, low, high = (g[k][a:a + _LEAVES] for k in ("feat", "low", "high"))
            flat = g["table"][a:a + _LEAVES].reshape(-1, d)
            first = (np.arange(len(feat), dtype=np.int32) << d)[:, None]
            orders = [np.argsort(feat[:, j], kind="stable") for j in range(d)]
            for s in range(0, len(x), _ROWS):
                at = np.repeat(first, min(_ROWS, len(x) - s), axis=1)
                for j in range(d):
                    own = rank[feat[:, j], s:s + _ROWS]
                    at |= ((own > low[:, j, None]) & (own <= high[:, j, None])).astype(np.int32) << j
                for j in range(d):
                    order = orders[j]
                    names, start = np.unique(feat[order, j], return_index=True)
                    phi[names, s:s + _ROWS] += np.add.reduceat(flat[:, j].take(at[order]), start, axis=0)
    phi = phi.T
    return phi + dense_batch(x, p["dense"], n_features) if p["dense"] else phi


def dense_batch(x: np.ndarray, t: dict, n_features: int, chunk: int = 256) -> np.ndarray:
    """SHAP values (rows x features) of a NumPy batch, each leaf's sum taken for each row."""
    n = x.shape[0]
    phi = np.zeros((n, n_features))
    nl, depth = t["feat"].shape
    for s in range(0, nl, chunk):
        feat = t["feat"][s:s + chunk]
        lo, hi, r = t["lo"][s:s + chunk], t["hi"][s:s + chunk], t["r"][s:s + chunk]
        val, w = t["val"][s:s + chunk], t["w"][s:s + chunk]
        L = feat.shape[0]
        real = feat >= 0
        xf = x[:, np.where(real, feat, 0)]  # n x L x D
        o = ((xf > lo) & (xf <= hi) & real).astype(np.float64)
        rr = np.where(real, r, 1.0)
        # P(z) = Π_j (r_j + o_j z), coefficients 0..D
        p = np.zeros((n, L, depth + 1))
        p[:, :, 0] = 1.0
        for j in range(depth):
            oj = o[:, :, j][..., None]
            shifted = np.concatenate([np.zeros((n, L, 1)), p[:, :, :-1]], axis=2)
            p = p * rr[None, :, j, None] + shifted * oj
        for j in range(depth):
            if not real[:, j].any():
                continue
            oj, rj = o[:, :, j], rr[None, :, j]
            # Q = P / (r_j + o_j z): top-down recurrence when o_j = 1, plain division when o_j = 0.
            q1 = np.zeros((n, L, depth))
            q1[:, :, depth - 1] = p[:, :, depth]
            for k in range(depth - 1, 0, -1):
                q1[:, :, k - 1] = p[:, :, k] - rj * q1[:, :, k]
            q0 = p[:, :, :depth] / np.where(rj > 0, rj, 1.0)[..., None]
            q = np.where(oj[..., None] > 0, q1, q0)
            ssum = (q * w[None, :, :]).sum(axis=2)  # n x L
            contrib = val[None, :] * (oj - rj) * ssum * real[None, :, j]
            fj = np.where(real[:, j], feat[:, j], 0)
            onehot = np.zeros((L, n_features))
            onehot[np.arange(L), fj] = real[:, j]
            phi += contrib @ onehot
    return phi


LEAF_ARRAYS = ("feat", "lo", "hi", "r", "w", "val", "dlen")


def split_tables(t: dict, max_bytes: int) -> list[dict]:
    """Cut leaf tables into consecutive leaf ranges whose tables, patterns included, have at
    most ``max_bytes`` each (attributions are additive over leaves, so the ranges can be
    explained one after another and summed)."""
    n = len(t["val"])
    d = np.where(t["dlen"] <= TABLED, t["dlen"], 0)
    size = np.cumsum(sum(t[k][:1].nbytes for k in LEAF_ARRAYS) + 8 * d * (1 << d))
    cuts = [0]
    while cuts[-1] < n:
        before = size[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(size, before + max_bytes, "right"))))
    return [{**t, **{k: t[k][a:b] for k in LEAF_ARRAYS}} for a, b in zip(cuts, cuts[1:])] or [t]


def shap_values(df: DataFrame, model, features: Sequence[str], id_col: str = "id", kind: str | None = None,
                batch_rows: int = 2048, keep: Sequence[str] = (), max_broadcast_bytes: int = 128 << 20) -> DataFrame:
    """Per-row attributions ``shap_<feature>``, ``base_value`` and the model
    output being explained (``margin``), for every row of ``df``.  The feature
    values (and ``keep`` columns) travel with the row, so the views below need
    no join back to the data.

    The leaf tables are broadcast only up to ``max_broadcast_bytes``; a larger
    model is cut into leaf ranges under that size, each broadcast to its own
    chained ``mapInPandas`` stage that adds its share to running attribution
    columns (no join, no shuffle; the sum is exact)."""
    spark = df.sparkSession
    t = leaf_tables(spark, model, kind)
    parts = split_tables(t, max_broadcast_bytes)
    feats = list(features)
    k = len(feats)
    shap_cols = [f"shap_{f}" for f in feats]
    keep = [c for c in keep if c not in feats and c != id_col]
    kept_types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in keep}
    carried = (f"`{id_col}` string, " + "".join(f"`{c}` {kept_types[c]}, " for c in keep)
               + ", ".join(f"`{f}` double" for f in feats))
    running = ", ".join(f"`{c}` double" for c in shap_cols)

    def stage(bt, first: bool, last: bool):
        def run(batches):
            tab = bt.value
            for pdf in batches:
                for s in range(0, len(pdf), batch_rows):
                    part = pdf.iloc[s:s + batch_rows].reset_index(drop=True)
                    x = part[feats].to_numpy(dtype=np.float64)
                    phi = shap_batch(x, tab, k)
                    if not first:
                        phi += part[shap_cols].to_numpy(dtype=np.float64)
                    res = pd.concat([part[[id_col, *keep, *feats]], pd.DataFrame(phi, columns=shap_cols)], axis=1)
                    if last:
                        res["base_value"] = tab["base"]
                        res["margin"] = tab["base"] + phi.sum(axis=1)
                    yield res
        return run

    cur = df.select(F.col(id_col).cast("string").alias(id_col), *[F.col(f"`{c}`") for c in keep],
                    *[F.col(f"`{f}`").cast("double").alias(f) for f in feats])
    for n, tab in enumerate(parts):
        first, last = n == 0, n == len(parts) - 1
        schema = f"{carried}, {running}" + (", base_value double, margin double" if last else "")
        cur = cur.mapInPandas(stage(spark.sparkContext.broadcast(pattern_tables(tab)), first, last), schema)
    return cur


def model_margin(model, df: DataFrame, kind: str | None = None) -> DataFrame:
    """What the attributions must add up to: 2F for boosted trees, p1 for forests."""
    kind = kind or ("gbt" if type(model).__name__.startswith("GBT") else "rf")
    from pyspark.ml.functions import vector_to_array

    tr = model.transform(df)
    if kind == "gbt":
        return tr.withColumn("model_output", F.lit(2.0) * vector_to_array("rawPrediction")[1])
    return tr.withColumn("model_output", vector_to_array("probability")[1])


# ---------------------------------------------------------------------------
# Views over the attribution table
# ---------------------------------------------------------------------------
def long_form(shap: DataFrame, features: Sequence[str], id_col: str = "id") -> DataFrame:
    """(id, feature, value, shap) — unpivoted from the attribution table,
    which already carries the feature values (no join)."""
    return shap.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("value"), F.col(f"`shap_{f}`").alias("shap"))
        for f in features])).alias("_s")).select(id_col, "_s.*")


def mean_abs(shap: DataFrame, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Mean |attribution| per feature (one aggregate), ranked."""
    one = shap.agg(*[F.avg(F.abs(F.col(f"`shap_{f}`"))).alias(f"m{i}") for i, f in enumerate(features)])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m{i}").alias("mean_abs_shap"))
                                          for i, f in enumerate(features)])).alias("_s")).select("_s.*")
    w = Window.orderBy(F.col("mean_abs_shap").desc(), F.col("feature"))  # over ≤ #features rows
    ranked = long.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def waterfall(shap: DataFrame, features: Sequence[str], row_id: str, id_col: str = "id",
              max_display: int = 15) -> DataFrame:
    """One row's breakdown — base, contributions ordered by |shap| (top
    ``max_display - 1`` shown, the rest folded into one line), running total."""
    lf = long_form(shap.filter(F.col(id_col) == row_id), features, id_col)
    base = shap.filter(F.col(id_col) == row_id).select("base_value")
    w = Window.orderBy(F.abs("shap").desc(), F.col("feature"))  # ≤ #features rows of one id
    ranked = lf.withColumn("rank", F.row_number().over(w))
    shown = ranked.filter(F.col("rank") < max_display).select("rank", "feature", "value", "shap")
    rest = ranked.filter(F.col("rank") >= max_display).agg(F.sum("shap").alias("shap"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    rest = rest.select(F.lit(max_display).alias("rank"), F.concat(F.col("n").cast("string"), F.lit(" other features")).alias("feature"),
                       F.lit(None).cast("double").alias("value"), "shap")
    steps = shown.unionByName(rest).withColumn("base_value", scalar_values(base)["base_value"])
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn("cumulative", F.col("base_value") + F.sum("shap").over(run))


def dependence(shap: DataFrame, features: Sequence[str], feature: str, id_col: str = "id", bins: int = 100) -> DataFrame:
    """(value, shap) of one feature, plus its partner: the feature whose value correlates
    most (in absolute value) with that attribution inside bins of the main feature, summed
    over the bins by their rows. ``bins`` is the number of bins for any number of rows (100:
    50 rows each in a sample of 5,000); attributions are compared to 12 digits."""
    j = shap.select(id_col, F.col(f"`shap_{feature}`").alias("shap"), *[F.col(f"`{f}`") for f in features])
    others = [f for f in features if f != feature]
    known = j.where(F.col(f"`{feature}`").isNotNull()).select(F.col(f"`{feature}`").alias("_main"), F.round("shap", 12).alias("_shap"), *[F.col(f"`{f}`").alias(f"_o{i}") for i, f in enumerate(others)])
    binned = quantile_bins(known, "_main", bins)

    def corr(o: str):
        # 0, not an error, where either side is constant in the bin.
        spread = F.stddev_pop(F.when(F.col(o).isNotNull(), F.col("_shap"))) * F.stddev_pop(o)
        return F.least(F.coalesce(F.abs(F.try_divide(F.covar_pop("_shap", o), spread)), F.lit(0.0)), F.lit(1.0))

    per_bin = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), *[corr(f"_o{i}").alias(f"c{i}") for i in range(len(others))])
    one = per_bin.agg(*[F.sum(F.col("_n") * F.col(f"c{i}")).alias(f"c{i}") for i in range(len(others))])
    best = one.select(F.explode(F.array(*[F.struct(F.coalesce(F.col(f"c{i}"), F.lit(0.0)).alias("c"), F.lit(f).alias("f"))
                                          for i, f in enumerate(others)])).alias("_s")).orderBy(F.col("_s.c").desc(), F.col("_s.f")).limit(1)
    best = scalar_values(best.select(F.col("_s.f").alias("interaction_feature")))["interaction_feature"]
    return j.select(id_col, F.col(f"`{feature}`").alias("value"), "shap", best.alias("interaction_feature"))


def pick_rows(scored: DataFrame, id_col: str = "id", label: str = "target", score: str = "score",
              high: float = 0.7, low: float = 0.15) -> DataFrame:
    """First (by id) defaulted row with score >= ``high`` and first paid row
    with score <= ``low``; when none qualifies, the first row above the 95th /
    below the 5th score percentile (computed only in that case)."""
    def first(cond, name):
        return scored.filter(cond).orderBy(id_col).limit(1).select(F.lit(name).alias("kind"), id_col, score, label)

    hi = first((F.col(label) == 1) & (F.col(score) >= high), "high_risk")
    lo = first((F.col(label) == 0) & (F.col(score) <= low), "low_risk")
    if hi.isEmpty() or lo.isEmpty():
        q = exact_quantiles(scored, score, [0.95, 0.05]).first()
        if hi.isEmpty():
            hi = first(F.col(score) >= F.lit(q["q_0"]), "high_risk")
        if lo.isEmpty():
            lo = first(F.col(score) <= F.lit(q["q_1"]), "low_risk")
    return hi.unionByName(lo)


def compare_rows(shap: DataFrame, features: Sequence[str], picks: DataFrame, top_features: DataFrame,
                 id_col: str = "id") -> DataFrame:
    """Values and attributions of the picked rows on the top features, one
    row per feature and a column pair per picked row (picks: two rows, broadcast)."""
    chosen = shap.join(F.broadcast(picks.select(F.col(id_col).cast("string").alias(id_col), "kind")), id_col)
    lf = long_form(chosen, features, id_col).join(F.broadcast(picks.select(F.col(id_col).cast("string").alias(id_col), "kind")), id_col)
    lf = lf.join(F.broadcast(top_features.select("feature", "rank")), "feature")
    return lf.groupBy("rank", "feature").pivot("kind", ["high_risk", "low_risk"]).agg(
        F.round(F.first("value"), 3).alias("value"), F.round(F.first("shap"), 4).alias("shap"))
