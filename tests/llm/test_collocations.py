"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter

import pytest

from creditlens.llm.collocations import collocations

from .conftest import SF


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, top=2000, least=30):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    swallowed = set()
    for (lang, g), a in found.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                if 100 * a >= 80 * found[lang, g[i : i + k]]:
                    swallowed.add((lang, g[i : i + k]))
    out = []
    for lang in n:
        mine = []
        for (x, g), a in found.items():
            if x == lang and (x, g) not in swallowed:
                cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
                s, k = min(cuts)
                mine.append((-s, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def result(df, **kw):
    out = collocations(df, **kw)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("kw", [{}, {"top": 20}, {"top": 5, "least": 3}, {"top": 300, "least": 4}])
def test_whole_table(spark, kw):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = result(df, **kw)
    assert got == brute([(r.text, r.lang) for r in df.select("text", "lang").collect()], **kw)
    assert got


def test_swallowed_phrases_and_ties(spark):
    """Fixed phrases of two to five words, with parts of their own, in two languages and none."""
    rng = random.Random(1)
    phrases = [[f"p{k}w{i}" for i in range(2 + k % 4)] for k in range(40)]
    rows = []
    for d in range(300):
        parts = []
        for _ in range(30):
            p = rng.choice(phrases)
            cut = p if rng.random() < 0.7 else p[: rng.randint(1, len(p))]
            parts.append(" ".join(cut) + rng.choice([" ", " ", ". ", "\n", " Other "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None])))
    rows += [(None, "en"), ("", "fr"), ("?!", "fr"), (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(t, x, "a", 1) for t, x in rows], "text string, lang string, key string, t1 int").repartition(4)
    for kw in ({"top": 10}, {"top": 60}, {"top": 3, "least": 60}):
        assert result(df, **kw) == brute(rows, **kw)


def test_empty(spark, empty_docs, odd_docs):
    assert result(empty_docs) == []
    assert result(odd_docs, least=2) == brute([(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()], least=2)
