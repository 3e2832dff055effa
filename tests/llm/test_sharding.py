"""Shards against cumulative sums over the sorted records."""

import zlib

from creditlens.llm.sharding import _sortable, shards

from .conftest import SF


def brute(rows, n=24):
    def order(r):
        return (zlib.crc32((r[1] or "").encode()), r[0] is not None, r[0] or 0)

    sizes = [len((t or "").encode()) + 8 for _, t in sorted(rows, key=order)]
    total, before, at, out = sum(sizes), 0, {}, []
    for (doc, text), size in zip(sorted(rows, key=order), sizes):
        s = before * n // total
        out.append((doc, size, zlib.crc32((text or "").encode()), "bytes", s, at.get(s, 0), None))
        at[s] = at.get(s, 0) + 1
        before += size
    return sorted(out, key=repr)


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in shards(df, **kw).collect()), key=repr)
    assert got == brute(rows, kw.get("n_shards", 24))
    return got


def test_table(spark):
    got = check(spark.read.parquet(f"{SF}/documents.parquet"))
    sizes, largest = {}, max(r[1] for r in got)
    for r in got:
        sizes[r[4]] = sizes.get(r[4], 0) + r[1]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_odd_documents(odd_docs):
    check(odd_docs)
    check(odd_docs, n_shards=3, per_range=1)


def test_overfull_ranges(spark):
    """One text in most rows and a sample of one key per range: ranges must be subdivided."""
    rows = [(i, "same text") for i in range(3000)] + [(9000 + i, f"text {i}" * 9) for i in range(300)] + [(7, "long " * 20_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), per_range=1)


def test_equal_rows_and_empty_table(spark, empty_docs):
    df = spark.createDataFrame([(1, "a")] * 500, "doc_id long, text string")
    got = shards(df).groupBy("shard").count().collect()
    assert sum(r["count"] for r in got) == 500 and {r["count"] for r in got} <= {20, 21}
    assert shards(empty_docs).count() == 0
    assert shards(empty_docs, carried=["text", "lang"]).columns[-1] == "row"


def test_sortable_keys():
    columns = [(-5, 0, 0, 1 << 62, 0), (0, -(1 << 63), 256, 0, 1), (0, 0, 0, 1, 0)]
    keys = list(zip(*columns))
    by_bytes = [k for _, k in sorted(zip(_sortable(*columns).tolist(), keys))]
    assert by_bytes == sorted(keys)
