"""The saved preparation, the radix split, levels and modes."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from creditlens.operators import features as fe
from creditlens.operators import preparation as pr
from creditlens.operators.stats import correlation_pairs, point_biserial
from creditlens.plans import inputs
from creditlens.session import scratch_path

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def saved(spark):
    path = scratch_path(spark, "preparation")
    pr.fit_preparation(inputs.loans(spark, SF_SMALL)).write().save(path)
    return PipelineModel.load(path)


def test_loaded_preparation_equals_prepare(spark, saved):
    loans = inputs.loans(spark, SF_SMALL)
    want, stats = fe.prepare(loans)
    names = saved.stages[-1].fitted["features"]
    assert names == stats["features"]
    got = {r.id: r.v for r in saved.transform(loans).select("id", vector_to_array("features").alias("v")).collect()}
    for r in want.collect():
        assert all(abs(a - float(r[c])) < 1e-9 for a, c in zip(got[str(r.id)] if str(r.id) in got else got[r.id], names))


def test_schema_without_data(spark, saved):
    loans = inputs.loans(spark, SF_SMALL)
    schema = loans.schema
    for stage in saved.stages:
        schema = stage.transformSchema(schema)
    out = saved.transform(loans)
    assert [(f.name, f.dataType) for f in schema] == [(f.name, f.dataType) for f in out.schema]
    with pytest.raises(ValueError, match="annual_inc"):
        saved.transform(loans.drop("annual_inc"))


def test_preparation_of_a_stream(spark, saved, tmp_path):
    loans = inputs.loans(spark, SF_SMALL).drop("target")
    loans.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(loans.schema).parquet(str(tmp_path / "in"))
    run = saved.transform(stream).select("id", "features").writeStream.format("parquet")
    run.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == loans.count()


def test_unknown_levels_and_missing_values(spark, saved):
    loans = inputs.loans(spark, SF_SMALL)
    odd = loans.limit(1).select("id", *[F.lit(None).cast(loans.schema[c].dataType).alias(c) for c in fe.PREP_FEATURES if c != "target"])
    odd = odd.withColumn("purpose", F.lit("never seen"))
    row = saved.transform(odd).select(vector_to_array("features").alias("v")).first()
    at = {c: i for i, c in enumerate(saved.stages[-1].fitted["features"])}
    assert all(row.v[i] == 0 for c, i in at.items() if c.startswith("purpose_"))
    assert all(x == x for c, x in zip(at, row.v) if c != "credit_history_years")


def test_radix_split_against_a_window(spark):
    import hashlib

    rng = random.Random(4)
    rows = [(f"x{rng.randrange(10**6)}-{i}", float(rng.random() < 0.3)) for i in range(2000)] + [("only", 2.0), ("ü", None), (None, 0.0)]
    df = spark.createDataFrame(rows, "id string, target double")
    for digits, levels in ((4, 2), (1, 1), (1, 4), (2, 0)):
        got = {(r.id, r.target): r.is_test for r in fe.radix_split(df, digits=digits, levels=levels).collect()}
        assert len(got) == 2002
        for t in (0.0, 1.0, 2.0):
            own = sorted((hashlib.md5((i or "").encode()).hexdigest(), i or "", i) for i, x in rows if x == t)
            k = int(0.2 * len(own) + 0.5)
            assert [got[i, t] for _, _, i in own] == [j < k for j in range(len(own))]
    windows = [ln for ln in fe.radix_split(df)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number" in ln]
    assert windows and fe.radix_split(df.limit(0)).count() == 0


def test_levels_are_bounded_and_modes_counted(spark):
    df = spark.createDataFrame([(f"v{i % 50}", "b" if i % 2 else "a", None) for i in range(400)], "many string, few string, none string")
    assert fe.fit_levels(df, ["few", "none"]) == {"few": ["a", "b"], "none": []}
    assert len(fe.fit_levels(df, ["many"], most=50)["many"]) == 50
    for most in (49, 3):
        with pytest.raises(fe.TooManyLevels):
            fe.fit_levels(df, ["many"], most=most)
    assert fe.fit_imputer(df, [], ["many", "few", "none"])["mode"] == {"many": "v0", "few": "a", "none": None}


def test_correlations_with_nulls(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) + rng.normal(size=(500, 1))
    hole = rng.random((500, 4)) < 0.3
    rows = [tuple(None if h else float(v) for v, h in zip(a, b)) + (1.0, float(a[0] > 0)) for a, b in zip(x, hole)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, same double, target double")
    got = {(r.feature_1, r.feature_2): r.correlation for r in correlation_pairs(df, list("abcd") + ["same"]).collect()}
    for i, p in enumerate("abcd"):
        assert got[p, "same"] is None
        for j, q in list(enumerate("abcd"))[i + 1 :]:
            both = ~hole[:, i] & ~hole[:, j]
            assert abs(got[p, q] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-9
    n = {r.feature: r.n for r in point_biserial(df, list("abcd"), with_p=False).collect()}
    assert n == {p: int((~hole[:, i]).sum()) for i, p in enumerate("abcd")}
