"""The registered queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import collocations, fertility, minhash, mixing, phrases, pulearn, secrets, sharding, suffixes, tokenfile, urls, variants, warc
from .common import documents

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Weights of the mix by level; names that are not listed weigh 1.
WEIGHTS = {"domain": {"web": 5, "books": 3, "forum": 2}, "lang": {"en": 6, "de": 2}}
#: The tables have no domain, so that of a source is read off its number.
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN right(source, 1) IN ('5', '6', '7') THEN 'books' ELSE 'forum' END"
MIX_PERCENT, MIX_EPOCHS = 80, 3


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir), 24)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(documents(spark, sf_dir, "pages"), documents(spark, sf_dir, "labels"), RULES)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(documents(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), MIX_PERCENT, MIX_EPOCHS, WEIGHTS, DOMAIN)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(documents(spark, sf_dir))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_url_filters, op3_secrets, op4_warc, op5_quality, op6_decontamination, op7_mixing, op8_quality_rules, op9_near_duplicates, op10_token_files, op11_collocations, op12_variants, op13_suffix_dedup)
} | {"pipeline": corpus_pipeline.run}

#: The other queries need tokenizers, a fitted model, file formats or CRC-32, which SQL lacks.
ORACLES = {
    "op4_warc": warc.ORACLE,
    "op6_decontamination": phrases.oracle("documents", "benchmark"),
    "op7_mixing": mixing.oracle("documents", MIX_PERCENT, MIX_EPOCHS, WEIGHTS, DOMAIN),
    "op9_near_duplicates": minhash.oracle("documents"),
    "op11_collocations": collocations.oracle("documents"),
}
