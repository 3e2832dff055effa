"""From raw documents to shards: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of
``documents``. Every stage defines its result for nulls, empty tables, repeated rows and
further columns in its operator's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from creditlens.llm import fertility, minhash, mixing, phrases, sharding
from creditlens.llm.common import discard, documents, in_turn, staged

#: The mix takes at most one epoch, so no document that passed deduplication is repeated,
#: and nearly all tokens: only sources that outweigh their targets give some up.
MIX_PERCENT = 95
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2}}
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'forum' END"
N_SHARDS = 24


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep."""
    return fertility.keep_good(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.unique_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten benchmark words."""
    return phrases.without_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The leaves' prefixes under the target weights."""
    taken = mixing.mix(docs, MIX_PERCENT, 1, WEIGHTS, DOMAIN, carried=docs.columns)
    return taken.select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot, with its other columns but those of the result's names."""
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row"}
    out = sharding.shards(docs, N_SHARDS, carried=[c for c in docs.columns if c.lower() not in own])
    return out.select(*[c for c in out.columns if c != "row"], "row.*")


# What a stage has staged for its result is deleted when the next one is given that result, written.
quality = in_turn(None, quality)
near_duplicates = in_turn(quality, near_duplicates)
decontaminate = in_turn(near_duplicates, decontaminate)
mix = in_turn(decontaminate, mix)
shard = in_turn(mix, shard)
STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        written = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if hasattr(docs, "staged_at"):
            discard(docs)
        docs = written
    return docs
