"""Round trips of the file format, and ids against whole-text encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from creditlens.llm.tokenfile import EliasFano, TokenFile, WordEncoder, token_files, write_token_files

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER, WHOLE = WordEncoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 45), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef = EliasFano.from_bytes(EliasFano.encode(np.array(values, np.uint64)).to_bytes())
    assert not values or ef.between(0, len(values)).tolist() == values
    for a in range(0, len(values), 3):
        assert ef.between(a, min(a + 7, len(values))).tolist() == values[a : a + 7]
    for v in {0, *values}:
        assert ef.first_above(v) == sum(x <= v for x in values)
    assert [ef.select(i) for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_elias_fano_space():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 200_000)).astype(np.uint64)
    ef = EliasFano.encode(values)
    assert ef.between(0, len(values)).tolist() == values.tolist()
    assert ef.ranks.nbytes <= ef.high.nbytes // 16 + 64
    assert 8 * len(ef.to_bytes()) / len(values) < 2.2 + np.log2(values[-1] / len(values))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(" \t\n\r\x0b\x0c\xa0 a'sÉΣς́<|endoftext|>0漢", max_size=40), st.sampled_from(["<|endoftext|>", "a<|startoftext|>b c", "x <|endoftext|>'s"])), min_size=1, max_size=5))
def test_words_encode_as_whole_texts(texts):
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    flat, at = ENCODER.ids(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    whole = [e.ids for e in WHOLE.encode_batch([r.decode() for r in raw], add_special_tokens=False)]
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == whole


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()) if r[1] is not None else -1)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in token_files(docs, PATH).collect()), key=repr) == brute(rows)


def test_odd_documents(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in token_files(odd_docs, PATH).collect()), key=repr) == brute(rows)


def test_random_access_and_empty_table(spark, odd_docs, empty_docs):
    assert token_files(empty_docs, PATH).count() == 0
    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in odd_docs.where("doc_id >= 100").select("doc_id", "text").collect()}
    seen = 0
    for r in write_token_files(odd_docs.where("doc_id >= 100"), PATH, 2).collect():
        f = TokenFile(r.path)
        for i, doc in enumerate(f.doc_ids(0, len(f))):
            assert f.tokens(i).tolist() == [*t.encode(texts[doc], add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == len(texts)


def test_regular_words_and_wide_vocabularies(spark, monkeypatch):
    """Words that a polynomial hash confuses, with a memory that starts afresh all the time; ids of 32 bits."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from creditlens.llm import tokenfile, words

    from .test_words import thue_morse

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = [" ".join(thue_morse(1024)), " ".join(reversed(thue_morse(256))), "a b c a b d " * 9]
    encoder = tokenfile.WordEncoder(path)
    encoder.memory = words.TokenMemory(slots=3, most=5)
    for _ in range(2):
        data = "".join(texts).encode()
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        flat, at = encoder.ids(np.frombuffer(data, np.uint8), offsets)
        for i, t in enumerate(texts):
            assert flat[at[i] : at[i + 1]].tolist() == own.encode(t, add_special_tokens=False).ids
    assert encoder.width == 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    narrow = sorted(map(tuple, tokenfile.token_files(docs, path).collect()))
    manifest = tokenfile.write_token_files(docs, path, 2)
    widths = [tokenfile.TokenFile(r.path).info["width"] for r in manifest.collect()]
    assert set(widths) == {2} and len(narrow) == 3
