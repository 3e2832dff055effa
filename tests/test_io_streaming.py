"""CSV round trip with missing words, Parquet sink, and the streaming counter
agreeing with the batch count."""

import tempfile

from pyspark.sql import functions as F

from creditlens.operators import population as pop
from creditlens.plans import inputs
from creditlens.sources import files
from creditlens.streaming import counts

from .conftest import SF_SMALL


def test_rejected_csv_roundtrip(spark):
    rej = inputs.rejected(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="cl-csv-")
    raw = rej.select(*[F.col(v).alias(k) for k, v in files.REJECTED_COLUMNS.items()])
    raw = raw.withColumn("Employment Length", F.coalesce(F.col("`Employment Length`"), F.lit("n/a")))
    raw.write.mode("overwrite").option("header", True).csv(out)
    back = files.read_rejected_csv(spark, out)
    assert back.count() == rej.count()
    # 'n/a' words come back as missing, like pandas
    assert back.filter(F.col("emp_length") == "n/a").count() == 0
    assert back.filter(F.col("emp_length").isNull()).count() == rej.filter(F.col("emp_length").isNull()).count()
    a = pop.yearly_counts(pop.clean_rejected(back), name="n").orderBy("year").collect()
    b = pop.yearly_counts(pop.clean_rejected(rej), name="n").orderBy("year").collect()
    assert a == b


def test_csv_is_split_unless_fields_hold_line_breaks(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("id,note\n" + "".join(f"{i},x\n" for i in range(5000)) + '5000,"a\nb"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert files.read_csv(spark, str(path)).rdd.getNumPartitions() > 1
        whole = files.read_csv(spark, str(path), multi_line=True)
        assert whole.rdd.getNumPartitions() == 1
        assert whole.count() == 5001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_streaming_yearly_counts_match_batch(spark):
    rej = inputs.rejected(spark, SF_SMALL)
    folder = tempfile.mkdtemp(prefix="cl-stream-")
    rej.repartition(3).write.mode("overwrite").parquet(folder)
    stream = counts.yearly_counts_stream(spark, folder, rej.schema)
    got = {r["year"]: r["n"] for r in counts.run_to_table(stream, "rej_years_test").collect()}
    exp = {r["year"]: r["n"] for r in pop.yearly_counts(pop.clean_rejected(rej), first=0, last=9999, name="n").collect()}
    assert got == exp


def test_parquet_sink_and_head_vs_sample(spark):
    loans = inputs.loans(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="cl-pq-")
    files.write_parquet(loans, out)
    assert files.read_parquet(spark, out, ["id", "target"]).count() == loans.count()
    assert files.head_rows(loans, 10).count() == 10
    s = files.sample_rows(loans, 0.5, seed=1).count()
    assert 0 < s < loans.count()


def test_streaming_scores_equal_batch_scores(spark):
    import uuid

    from pyspark.ml.classification import LogisticRegression

    from creditlens.operators import models as mo

    loans = inputs.loans(spark, SF_SMALL).filter(F.col("target").isNotNull())
    cols = ["loan_amnt", "int_rate", "open_acc"]
    data = loans.select("id", "target", *[F.col(c).cast("double").alias(c) for c in cols]).na.drop()
    model = LogisticRegression(featuresCol="features", labelCol="target", maxIter=20).fit(mo.assemble(data, cols))
    folder = tempfile.mkdtemp(prefix="cl-score-")
    data.repartition(2).write.mode("overwrite").parquet(folder)
    stream = counts.score_stream(spark, model, folder, data.schema, cols).select("id", "score")
    name = f"scores_{uuid.uuid4().hex[:8]}"
    got = {r["id"]: r["score"] for r in counts.run_to_table(stream, name, mode="append").collect()}
    exp = {r["id"]: r["score"] for r in mo.score(model, mo.assemble(data, cols)).select("id", "score").collect()}
    assert got.keys() == exp.keys()
    assert all(abs(got[k] - exp[k]) < 1e-12 for k in exp)


def test_stream_is_killed_and_resumed(spark, monkeypatch):
    """A micro-batch that dies after writing is run again when the stream goes on; every row counts once."""
    import pytest
    from pyspark.errors import StreamingQueryException

    rej = spark.range(3000).select(F.concat((F.col("id") % 5 + 2010).cast("string"), F.lit("-03-01")).alias("application_date"))
    src, folder = tempfile.mkdtemp(prefix="cl-src-"), tempfile.mkdtemp(prefix="cl-sink-")
    rej.repartition(6).write.mode("overwrite").parquet(src)
    save, died = counts.save_version, []

    def dies(batch, batch_id, table):
        save(batch, batch_id, table)
        if batch_id == 2:
            died.append(batch_id)
            raise RuntimeError("lost")

    monkeypatch.setattr(counts, "save_version", dies)
    make = lambda: counts.yearly_counts_stream(spark, src, rej.schema)
    with pytest.raises(StreamingQueryException):
        counts.run_to_table(make(), "killed", folder=folder)
    monkeypatch.setattr(counts, "save_version", save)
    got = {r["year"]: r["n"] for r in counts.run_to_table(make(), "resumed", folder=folder).collect()}
    assert died and got == {y: 600 for y in range(2010, 2015)}
    more = spark.range(10).select(F.lit("2012-01-01").alias("application_date"))
    more.coalesce(1).write.mode("append").parquet(src)
    got = {r["year"]: r["n"] for r in counts.run_to_table(make(), "again", folder=folder).collect()}
    assert got[2012] == 610 and sum(got.values()) == 3010
