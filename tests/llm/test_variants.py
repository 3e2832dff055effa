"""Spelling variants against an edit-distance comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from creditlens.llm import variants as V

from .conftest import SF


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least_n=5, every=199):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", fold(text)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += len(run) >= 6
    words = {w: n for w, n in count.items() if n >= least_n}
    alphabet = sorted({c for w in words for c in w})
    near = {}
    for w in words:
        other = {w[:i] + w[i + 1 :] for i in range(len(w))}
        for c in alphabet:
            other |= {w[:i] + c + w[i:] for i in range(len(w) + 1)} | {w[:i] + c + w[i + 1 :] for i in range(len(w))}
        near[w] = sorted((-words[x], x) for x in other - {w} if x in words)
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 5 * words[w] else None for w in words}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def result(df, **kw):
    out = V.variants(df, **kw)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("most", [20_000, 50, 1])
def test_whole_table(spark, most):
    """Subtrees that are never, sometimes and always divided give the same."""
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    want = brute(list(zip(t["doc_id"], t["text"])))
    assert sum(r[1] is not None for r in want) > 5
    assert result(spark.read.parquet(f"{SF}/documents.parquet"), most=most) == want


def test_chains_ties_and_long_words(spark):
    long = "abcdefghij" * 30
    rows = [(1, "garden " * 700 + "gardens " * 130 + "gardenss " * 26 + "gardensss " * 5), (2, "gerden " * 9 + "girden " * 9 + "Égarden égarden " * 6),
            (3, (long + " ") * 30 + (long + "x ") * 5 + ("y" + long[1:] + " ") * 6), (None, "lonely " * 8), (4, None), (5, ""), (6, "12 34 ?!"), (1, "garden " * 3)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, word string, node string").repartition(3)
    got = result(df)
    assert got == brute(rows)
    by = {r[0]: r for r in got}
    assert by["gardensss"][2] == "garden" and any(r[0].startswith("gardensss") for r in got)


def test_random_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abà") for _ in range(rng.randint(6, 9))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(40)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), most=30) == brute(rows)


def test_odd_and_empty(spark, odd_docs, empty_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(odd_docs) == brute(rows)
    assert result(empty_docs) == []
