"""Near duplicates against a brute-force join of all pairs of full sets."""

import re

import pyarrow.parquet as pq

from creditlens.llm import minhash
from creditlens.llm.minhash import near_duplicates

from .conftest import SF


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=75):
    """(doc_id, n_shingles, component_id) per row, from every pair of distinct sets."""
    sets = sorted({shingles(t) for _, t in rows}, key=lambda s: sorted(s))
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in by[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                top[find(i)] = find(j)
    place = {s: i for i, s in enumerate(sets)}
    least = {}
    for doc, t in rows:
        if shingles(t) and doc is not None:
            c = find(place[shingles(t)])
            least[c] = min(least.get(c, doc), doc)
    return sorted(((d, len(shingles(t)), least.get(find(place[shingles(t)])) if shingles(t) else d) for d, t in rows), key=repr)


def result(df, **kw):
    rows = near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


def test_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert result(odd_docs) == brute(rows)


def test_empty_table(empty_docs):
    assert result(empty_docs) == []


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    assert result(spark.read.parquet(f"{SF}/documents.parquet")) == brute(rows)


def test_chain_and_families(spark):
    """A long chain of edits, and two families that are alike but under the threshold."""
    words = [f"c{i}" for i in range(100)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[(k * 7) % 100] = f"new{k}"
    half = [f"m{i}" for i in range(60)]
    for f in range(2):
        tail = [f"t{f}_{i}" for i in range(14)]
        for k in range(60):
            own = half + tail
            own[k] = f"own{f}_{k}"
            rows.append((1000 + 100 * f + k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def test_keys_are_deleted_before_sets_are_made(spark, monkeypatch):
    from creditlens.llm import common

    there, seen, full = set(common._STAGED), [], minhash._full_sets
    monkeypatch.setattr(minhash, "_full_sets", lambda *a: seen.append([t for t in common._STAGED - there if "/keys-" in t]) or full(*a))
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text), (2, text + " eleven"), (3, "other words")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert seen == [[]]


def test_open_buckets_are_compared_in_one_pass(spark, monkeypatch):
    """32 texts that are alike but differ in two blocks or more, and one that differs from some in a single block."""
    codes = [k for k in range(64) if bin(k).count("1") % 2 == 0] + [1]
    rows = [(i, " ".join(f"{'b' if b < 6 and k >> b & 1 else 'a'}{b}_{j}" for b in range(20) for j in range(5))) for i, k in enumerate(codes)]
    compared, n = minhash._compared, []
    monkeypatch.setattr(minhash, "_compared", lambda *a: n.append(1) or compared(*a))
    monkeypatch.setattr(minhash, "STARS", 0)
    for piece in (minhash.PIECE, 8):
        monkeypatch.setattr(minhash, "PIECE", piece)
        n.clear()
        assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
        assert len(n) == 2
