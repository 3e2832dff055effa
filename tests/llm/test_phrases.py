"""Phrase and proximity matches against plain string work."""

import hashlib
import os
import random
import re

import numpy as np

from creditlens.llm import phrases, words
from creditlens.llm.common import discard
from creditlens.llm.phrases import build_index, contamination, proximity_matches, without_contaminated

from .conftest import SF, prose
from .test_minhash import fold

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(fold(text))
        for i in range(len(w) - width + 1 if len(w) >= width else min(1, len(w))):
            windows.setdefault(tuple(w[i : i + width]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(fold(text))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= own
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def near(docs, items):
    """(doc, number of items all of whose words stand within twice their number), span by span."""
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, []).extend(WORD.findall(fold(text)))
    out = []
    for doc, text in docs:
        w = WORD.findall(fold(text))
        n = 0
        for own in wanted.values():
            kinds, span, count, found = set(own), 2 * len(own), {}, False
            for e, x in enumerate(w):
                if x in kinds:
                    count[x] = count.get(x, 0) + 1
                if e >= span and (old := w[e - span]) in kinds:
                    count[old] -= 1
                    if not count[old]:
                        del count[old]
                found |= len(count) == len(kinds) > 0
            n += found
        out.append((doc, n))
    return sorted(out, key=repr)


def check(docs, items):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    wanted = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    result = contamination(docs, items).collect()
    assert sorted((tuple(r)[:6] for r in result), key=repr) == wanted
    assert sorted(((r.doc_id, r.n_near) for r in result), key=repr) == near(rows, [(r.item_id, r.text) for r in items.collect()])
    clean = without_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((x[0] for x in wanted if not x[-1]), key=repr)


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))


def test_odd_documents(spark, odd_docs, monkeypatch):
    base = odd_docs.where("doc_id = 4").first().text
    long = odd_docs.where("doc_id = 12").first().text
    items = [(1, base[:200]), (2, "two words"), (2, "Two-Words!"), (3, None), (4, ""), (None, base), (5, long), (6, "w1"), (7, "漢字仮名")]
    items = spark.createDataFrame(items, "item_id long, text string")
    check(odd_docs, items)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    check(odd_docs, items)


def test_segments_and_neighbours(spark):
    """Phrases never reach over a document's end, also where neighbours hold their halves."""
    rng = random.Random(2)
    w = [f"x{i}" for i in range(20)]
    docs = [(0, " ".join(w[:10])), (1, " ".join(w[10:])), (2, " ".join(w)), (3, prose(rng, 50) + " " + " ".join(w[3:15])), (4, " ".join(w[2:9]))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check(docs, spark.createDataFrame([("a", " ".join(w[5:15])), ("b", " ".join(w)), ("c", "x2 x3")], "item_id string, text string"))


def test_runs_and_shared_windows(spark):
    """Runs are the hit words of a document, and a window that many items share is found for all."""
    w = [f"x{i}" for i in range(30)]
    docs = spark.createDataFrame([(0, " ".join(w[:12])), (1, " ".join(w[12:] + w[:10])), (2, None)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(k, " ".join(w[:10])) for k in range(300)] + [(300, "x13 x14"), (301, "x15")], "item_id long, text string")
    check(docs, items)
    got = {r.doc_id: r for r in phrases.phrase_matches(build_index(docs), items).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 10)] and len(got[0].items) == 300
    assert [tuple(x) for x in got[1].runs] == [(1, 4), (18, 28)] and got[2].runs == [] and got[2].items == []


def test_empty_tables(spark, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert contamination(empty_docs, some).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert contamination(docs, none).first().n_hit == 0 and contamination(docs, some).first().n_hit == 3


def test_proximity(spark):
    docs = [(1, "the cat sat on the mat"), (2, "mat of a very big old cat"), (3, "cat"), (4, "mat"), (5, "mat cat mat")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(9, "Mat, cat")], "item_id long, text string")
    got = lambda k: sorted((r.doc_id, r.n_spans) for r in proximity_matches(build_index(docs), items, k).collect())
    assert got(5) == [(1, 1), (5, 2)] and got(7) == [(1, 1), (2, 1), (5, 2)] and got(2) == [(5, 2)]


def test_proximity_of_an_item_longer_than_a_block(spark, monkeypatch):
    """An item of several chunks is searched as one: documents without some of its words are not returned."""
    w = [f"x{i}" for i in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(w[:4096])), (2, " ".join(w)), (3, " ".join(w[4096:]))], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    items = spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")
    assert [(r.doc_id, r.item, r.n_spans) for r in proximity_matches(build_index(docs), items, 6000).collect()] == [(2, "9", 1)]


def test_index_rows_only_name_their_segments(spark, monkeypatch):
    """What a task's rows hold does not grow with its segments' words; the files go with the index."""
    rng = random.Random(5)
    monkeypatch.setattr(phrases, "SEGMENT_WORDS", 1000)
    texts = [prose(rng, 300) + " word" * 60_000 for _ in range(5)]  # a block of text each
    docs = spark.createDataFrame([*enumerate(texts), (5, None), (None, "")], "doc_id long, text string").coalesce(1)
    found = contamination(docs, spark.createDataFrame([(1, texts[0][:300]), (2, "w1 w2")], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words) for r in found if r.n_words) == [(k, 60_300) for k in range(5)]
    assert all(r.n_hit >= 40 for r in found if r.doc_id == 0) and sum(r.n_words == 0 for r in found) == 2
    index = build_index(docs)
    rows = index.collect()
    assert len(rows) == 5 and max(len(str(r)) for r in rows) < 1000
    assert all(os.path.isfile(r.place.removeprefix("file:")) for r in rows)
    discard(index)
    assert not any(os.path.exists(r.place.removeprefix("file:")) for r in rows) and not os.path.exists(index.files_at.removeprefix("file:"))


def test_segments_are_dealt_out_over_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for n, parts in ((0, 1), (3, 3), (4 * cores, cores), (400, max(cores, 100))):
        dealt = phrases._dealt(spark.range(0, n, 1, 2))
        assert dealt.rdd.getNumPartitions() == parts and sorted(r.id for r in dealt.collect()) == list(range(n))


def test_places_are_looked_at_in_bounded_numbers(spark, monkeypatch):
    """Phrases of frequent words have many candidates together; a step takes a bounded number, or one phrase."""
    text = "a b " * 200 + "a c b"
    s = phrases._Segment(0, build_index(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1)).first().place)
    h = words.hashes(data := np.frombuffer(text.encode(), np.uint8), *words.spans(data, np.array([0, len(data)]), words.ALNUM)[:2], folded=True)
    asked = np.lib.stride_tricks.sliding_window_view(h, 2)
    whole, taken, step = phrases.occurrences(asked, s), [], phrases._in_a_row
    monkeypatch.setattr(phrases, "_in_a_row", lambda place, order, n, s: taken.append(n) or step(place, order, n, s))
    monkeypatch.setattr(phrases, "_CANDIDATES", 500)
    assert [x.tolist() for x in phrases.occurrences(asked, s)] == [x.tolist() for x in whole]
    assert len(taken) > 100 and all(n.sum() <= 500 or len(n) == 1 for n in taken)
    flat = h.tolist()
    assert sorted(zip(*(x.tolist() for x in whole))) == [(i, j) for i in range(len(asked)) for j in range(len(asked)) if flat[i : i + 2] == flat[j : j + 2]]
