import random

import pytest

SF = "/root/testdata/sf0.001"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty texts, ties, repeated rows, a very long text and clashing column names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(w if i % 40 else "changed" + str(i) for i, w in enumerate(words))
    far = " ".join(w if i % 4 else "other" + str(i) for i, w in enumerate(words))
    rows = [
        (1, base), (2, base), (3, near), (4, far), (5, None), (6, ""), (7, " \t\n"), (8, "Two words"), (9, "two WORDS"),
        (10, base.upper()), (1, base), (12, prose(rng, 30_000)), (None, base), (None, "only without an id here now then"), (13, "naïve — Ünïcode “text” 漢字仮名 🙂  x"),
    ]
    rows += [(100 + i, prose(rng, 60)) for i in range(10)]
    data = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None, -1, "x", "y") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, cls int, kept string, shard string").repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
