"""Counts against plain Python, figures against the vocabulary itself, bands against planted junk."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece

from creditlens.llm.fertility import keep_good, quality_rules

from .conftest import SF

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n)


def figures(text, sp):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tokens = [t for w in words for t in sp.encode(w)]
    if not tokens:
        return None, None, None
    p = [c / len(tokens) for c in Counter(tokens).values()]
    return sum(map(len, words)) / len(tokens), sum(sp.is_byte(t) for t in tokens) / len(tokens), -sum(x * math.log2(x) for x in p)


def check(df, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = quality_rules(df, MODEL).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in texts), key=repr)
    by_id = {i: t for i, t in texts if i is not None}
    for r in rows:
        assert not (r.base_failed and r.kept)
        if r.doc_id is not None:
            for a, b in zip((r.chars_per_token, r.byte_share, r.token_entropy), figures(by_id[r.doc_id], sp)):
                assert a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return rows


def test_odd_documents(odd_docs):
    check(odd_docs, [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(r.kept for r in rows) > 0.7 * sum(not r.base_failed for r in rows)
    kept = keep_good(docs, MODEL)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_lines_and_symbols(spark):
    texts = [(1, "a b\na b\n\n \n \na b \nc|d <e>\n"), (2, "x\r\nx\nx\r"), (3, "a a a a " * 20), (4, "漢字 " * 60 + "#*$%&|<>")]
    check(spark.createDataFrame([(i, t, None) for i, t in texts], "doc_id long, text string, lang string"), texts)


def test_planted_junk(spark):
    rng = random.Random(5)
    vocab = [w for w in "the people of this country have many good reasons to think that their children will learn more about music and history when schools offer better books and longer lessons in every season of the year".split()]
    clean = [" ".join(rng.choice(vocab) + rng.choice(["", "", "s", "ed"]) for _ in range(150)) for _ in range(300)]
    junk = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0189#%") for _ in range(9)) for _ in range(150)) for _ in range(12)]
    rows = [(i, t, "en") for i, t in enumerate(clean + junk)]
    kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 312))


def test_few_short_texts_among_long_ones(spark):
    """The trend with length is removed, so that short texts are held against short ones however few they are."""
    rng = random.Random(6)
    vocab = sorted({a + b + c for a in ("play", "work", "read", "walk", "talk", "look", "call", "help") for b in ("", "er", "ing", "ed", "s") for c in ("", "able", "ness", "ly", "ment")})
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = [text(rng.randrange(600, 1000)) for _ in range(200)]
    for n_short in (10, 45, 55):
        texts = long + [text(60) for _ in range(n_short)] + [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz0189#%") for _ in range(9)) for _ in range(60))]
        rows = [(i, t, "en") for i, t in enumerate(texts)]
        kept = {r.doc_id: r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), MODEL).collect()}
        assert all(kept[i] for i in range(len(texts) - 1)) and not kept[len(texts) - 1]


def test_empty_table(empty_docs):
    assert quality_rules(empty_docs, MODEL).count() == 0 and keep_good(empty_docs, MODEL).columns == empty_docs.columns


def test_workers_keep_no_vocabulary_for_later_steps(spark, odd_docs):
    def kept(batches):
        import gc

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Vocabulary" for x in gc.get_objects())])], ["n"])

    docs = odd_docs.repartition(8)
    assert quality_rules(docs, MODEL).count() == docs.count()
    later = spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").collect()
    assert len(later) >= 16 and sum(r["n"] for r in later) == 0
