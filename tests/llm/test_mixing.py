"""Mixing against DuckDB, and the budgets against water-filling in fractions."""

import random
from fractions import Fraction

import duckdb
from pyspark.sql import functions as F

from creditlens.llm.mixing import LEVELS, budgets, mix, oracle

from .conftest import SF

WEIGHTS = {"domain": {"web": 5, "rest": 3}, "lang": {"en": 6, "de": 2}}
DOMAIN = "CASE WHEN right(source, 1) IN ('0', '1', '2', '3', '4') THEN 'web' WHEN source IS NOT NULL THEN 'rest' END"


def check(spark, df, percent, epochs):
    got = sorted((tuple(r) for r in mix(df, percent, epochs, WEIGHTS, DOMAIN).collect()), key=repr)
    con = duckdb.connect()
    con.register("docs", df.select("doc_id", "text", "lang", "source").toArrow())
    wanted = sorted(con.execute(oracle("docs", percent, epochs, WEIGHTS, DOMAIN)).fetchall(), key=repr)
    assert got == wanted
    return got


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = docs.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    for percent, epochs in ((60, 3), (85, 1), (100, 1), (250, 4)):
        rows = check(spark, docs, percent, epochs)
        taken = sum(r[4] for r in rows)
        short = len({r[1:4] for r in rows}) * max(r[4] for r in rows)  # each leaf's prefix may end before a long text
        assert percent * words - 100 * short < 100 * taken <= percent * words


def test_odd_documents(spark, odd_docs):
    check(spark, odd_docs, 50, 2)
    check(spark, odd_docs, 100, 1)


def test_empty_table(spark, empty_docs):
    assert mix(empty_docs, 50, 2, WEIGHTS, DOMAIN).collect() == []
    assert mix(empty_docs, 50, 2, WEIGHTS, DOMAIN, carried=["text"]).columns[-1] == "row"


def fill(budget, nodes):
    """Water level by repeated filling: {name: (capacity, weight)}."""
    out, left = {}, dict(nodes)
    while left:
        unit = Fraction(budget - sum(out.values())) / sum(w for _, w in left.values())
        full = {k: c for k, (c, w) in left.items() if c <= unit * w}
        if not full:
            return out | {k: unit * w for k, (c, w) in left.items()}
        out |= full
        left = {k: x for k, x in left.items() if k not in full}
    return out


def test_budgets_go_to_siblings_first(spark):
    rng = random.Random(4)
    leaves = [(d, lang, f"s{k}", rng.choice([0, 5, 50, 500, 5000])) for d in ("web", "rest", "x") for lang in ("en", "de", "fr") for k in range(rng.randint(1, 5))]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    for percent, epochs in ((50, 1), (150, 2), (90, 1), (900, 3)):
        got = {tuple(r[c] for c in LEVELS): r.budget for r in budgets(df, percent, epochs, WEIGHTS).collect()}
        cap = lambda *at: sum(epochs * t for *k, t in leaves if tuple(k[: len(at)]) == at)  # noqa: B023, E731
        weight = lambda level, k: WEIGHTS.get(level, {}).get(k, 1)
        whole = min(sum(x[3] for x in leaves) * percent // 100, cap())
        for d, bd in fill(whole, {d: (cap(d), weight("domain", d)) for d in {x[0] for x in leaves}}).items():
            for lang, bl in fill(bd, {x[1]: (cap(d, x[1]), weight("lang", x[1])) for x in leaves if x[0] == d}).items():
                for s, bs in fill(bl, {x[2]: (cap(d, lang, x[2]), 1) for x in leaves if x[:2] == (d, lang)}).items():
                    assert abs(got[d, lang, s] - bs) <= 4
