"""Each stage of the pipeline against its brute-force version, on what the stage before it kept."""

import duckdb

import corpus_pipeline as cp
from creditlens.llm import mixing, queries
from creditlens.llm.common import documents, staged

from . import test_fertility, test_minhash, test_phrases, test_sharding
from .conftest import SF


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = documents(spark, SF)
    kept = [docs]
    for name, stage in cp.STAGES:
        kept.append(staged(stage(spark, kept[-1], SF), name.replace(" ", "_")))
    raw, good, unique, clean, mixed, sharded = kept
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    passed = {i for i, t in pairs(raw) if not test_fertility.brute(t)[-1]}
    assert set(ids(good)) <= passed and len(ids(good)) > 0.8 * len(passed)
    assert ids(unique) == sorted(i for i, _, c in test_minhash.brute(pairs(good)) if i == c)
    items = [(r.item_id, r.text) for r in documents(spark, SF, "benchmark").collect()]
    assert ids(clean) == sorted(r[0] for r in test_phrases.brute(pairs(unique), items) if not r[-1])
    con = duckdb.connect()
    con.register("docs", clean.toArrow())
    wanted = con.execute(mixing.oracle("docs", cp.MIX_PERCENT, 1, cp.WEIGHTS, cp.DOMAIN)).fetchall()
    assert ids(mixed) == sorted(r[0] for r in wanted)
    got = sorted((tuple(r) for r in sharded.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()), key=repr)
    assert got == test_sharding.brute(pairs(mixed), cp.N_SHARDS)
    assert {"text", "lang", "source", "n_chars"} <= set(sharded.columns)


def test_empty_and_odd_tables(spark, odd_docs, empty_docs):
    for docs in (empty_docs, odd_docs):
        for name, stage in cp.STAGES:
            docs = staged(stage(spark, docs, SF), name.replace(" ", "_"))
        assert "shard" in docs.columns


def test_one_query_for_each_operator():
    assert [n for n in range(1, 14)] == sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op"))
    assert "pipeline" in queries.QUERIES and set(queries.ORACLES) <= set(queries.QUERIES)
