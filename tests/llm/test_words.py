"""Word hashes: regular words, folding, long words."""

import numpy as np
import pytest

from creditlens.llm import words
from creditlens.llm.minhash import near_duplicates


def thue_morse(n):
    """Words of n letters over ab and ba that a polynomial hash modulo a power of two confuses."""
    out = [0]
    while len(out) < n:
        out += [1 - x for x in out]
    return "".join("ab"[x] for x in out), "".join("ba"[x] for x in out)


@pytest.mark.parametrize("n", [256, 1024, 4096, 65536, 1 << 18])
def test_regular_words_differ(n):
    one, other = thue_morse(n)
    data = np.frombuffer(f"{one} {other}\n{one.upper()} x".encode(), np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.SPACED)
    exact, folded = (words.hashes(data, starts, ends, f) for f in (False, True))
    assert len(set(exact.tolist())) == 4
    assert folded[0] == folded[2] and len(set(folded.tolist())) == 3


def test_hash_is_of_the_word_alone():
    data = np.frombuffer(b"aa b aa  ccc\xc3\xa9 aa" + b"z" * 70 + b" " + b"z" * 70, np.uint8)
    starts, ends, _ = words.spans(data, np.array([0, len(data)]), words.SPACED)
    h = dict()
    for s, e, v in zip(starts, ends, words.hashes(data, starts, ends, False)):
        assert h.setdefault(data[s:e].tobytes(), v) == v
    assert len(set(h.values())) == len(h) == 5


def test_near_duplicates_of_regular_words(spark):
    one, other = thue_morse(1024)
    rows = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(rows).collect()) == [(1, 1), (2, 2), (3, 1)]
