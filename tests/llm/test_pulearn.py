"""The risk on planted classes, held-out accuracy on the labelled table, odd tables."""

import zlib

import numpy as np

from creditlens.llm.pulearn import estimate_prior, features, held_out, score

SF = "/root/testdata/sf0.01"


def test_prior_of_planted_classes():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (4000, 5)), rng.normal(4, 1, (600, 5))
    assert abs(estimate_prior(good[:1500], np.concatenate([good[1500:3900], bad])) - 0.8) < 0.06


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert sum(held) > 0.93 * len(held)
    # Labels of the held-out fold are never read.
    other = labels.withColumn("quality", (1 - labels.quality) * held_out(labels.doc_id).cast("int") + labels.quality * (1 - held_out(labels.doc_id).cast("int")))
    assert sorted((r.doc_id, r.score) for r in score(docs, other).collect()) == sorted((r.doc_id, r.score) for r in rows)


def test_odd_documents(spark, odd_docs, empty_docs):
    labels = spark.createDataFrame([(i, 1, "x") for i in (1, 2, 3, 100, 101, 102)], "doc_id long, quality int, text string")
    rows = score(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (5, 6)}) == 1
    assert score(empty_docs, labels).count() == 0
    assert {r.score for r in score(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_features_do_not_depend_on_the_block():
    texts = ["One two, THREE 4!", "", "repeat repeat repeat", "ünï 漢字"]
    raw = [t.encode() for t in texts]
    whole = features(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    for row, r in zip(whole, raw):
        assert np.allclose(row, features(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0])


def test_sample_is_bounded_for_null_and_repeated_ids(spark):
    from pyspark.sql import functions as F

    from creditlens.llm.pulearn import _drawn

    none = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert all(7_400 < _drawn(none, 8_000, seed).count() < 8_600 for seed in (0, 32))
    again = spark.range(40_000).select((F.col("id") % 4).alias("doc_id"), F.lit("same").alias("text"))
    assert _drawn(again, 8_000, 32).count() == 4
