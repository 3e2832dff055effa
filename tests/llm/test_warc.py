"""Round trips through whole-file archives, the normaliser and the index."""

import gzip
import hashlib
import random
import zlib

import duckdb

from creditlens.llm import warc
from creditlens.llm.common import open_shared
from creditlens.session import scratch_path

from .conftest import SF

COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    out = []
    for i, p in data:
        same = [j for j, q in data if q == p and j is not None]
        shared = len(p) >= 1000 and sum(q == p for _, q in data) > 1 and same and i != max(same)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if shared else "response", max(same) if shared else None))
    return sorted(out, key=repr)


def result(df):
    got = warc.round_trip(df)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = result(pages)
    assert got == brute([(r.page_id, r.html) for r in pages.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    assert got == sorted(con.execute(warc.ORACLE).fetchall(), key=repr)


def test_odd_pages(spark):
    long = "é" * 700
    rows = [(1, "http://a/\r\nb c", long), (2, None, long), (2, "x", long), (None, "y", long), (3, "z", None), (4, "", ""), (5, "u", "short"), (6, "u", "short"), (7, "w", "WARC/1.1\r\n\r\n\r\n\r\n" + "x" * 2000), (8, "v", "漢🙂" * 400_000), (None, "q", "only " * 300), (None, "q", "only " * 300)]
    df = spark.createDataFrame([(*r, "digest", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int").repartition(3)
    assert result(df) == brute([(i, h) for i, _, h in rows])
    assert result(df.limit(0)) == []


def test_normalised_members(spark):
    rng = random.Random(6)
    rows = [(i, f"http://h/{i}", " ".join(str(rng.random()) for _ in range(300))) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = scratch_path(spark, "warc-test")
    whole = warc.write_archives(df, f"{folder}/whole")
    members = warc.normalise(whole, f"{folder}/members").collect()
    before = {r.path for r in whole.collect()}
    assert len(members) == len(before) == 1 and members[0].n_records == 40

    def data(path):
        fs, place = open_shared(path)
        with fs.open_input_stream(place, compression=None) as f:
            return f.read()

    raw, index = data(members[0].path), data(members[0]["index"]).decode().splitlines()
    z = zlib.decompressobj(31)
    z.decompress(data(next(iter(before))))
    assert z.eof and not z.unused_data  # one member holds everything
    assert gzip.decompress(raw) == gzip.decompress(data(next(iter(before))))
    at = 0
    for line, row in zip(index, sorted(rows)):
        offset, length, kind = line.split()
        assert int(offset) == at and kind == "response"
        fields, block = warc.parse(gzip.decompress(raw[at : at + int(length)]))
        assert fields["warc-target-uri"].startswith("http://h/") and block.startswith(b"HTTP/1.1 200 OK")
        at += int(length)
    assert at == len(raw)


def test_records_across_pieces():
    raw = [warc.record(i, "u", b"\r\n\r\nWARC/1.1\r\n" * i, None, hashlib.sha1(b"").hexdigest()) for i in range(5)]
    two = gzip.compress(b"".join(raw[:2])) + gzip.compress(b"".join(raw[2:]))
    for step in (1, 7, 100_000):
        assert list(warc.records(warc.inflated(two[k : k + step] for k in range(0, len(two), step)))) == raw


def test_cut_archives_raise_and_large_members_come_in_pieces():
    import gzip

    import pytest

    from creditlens.llm.warc import inflated

    parts = [b"a" * 1000, b"", bytes(range(256)) * 50, b"\0" * (3 << 20)]
    whole = b"".join(gzip.compress(p) for p in parts)
    for step in (1 << 16, 4097, 17 if len(whole) < 20_000 else 1009):
        pieces = [whole[i : i + step] for i in range(0, len(whole), step)]
        out = list(inflated(iter(pieces), most=1 << 16))
        assert b"".join(out) == b"".join(parts) and max(map(len, out)) <= 1 << 16
    assert list(inflated(iter([]))) == []
    edge = len(gzip.compress(parts[0]))
    assert b"".join(inflated(iter([whole[:edge]]))) == parts[0]
    for cut in (edge - 1, edge - 8, edge + 5, len(whole) - 4):
        with pytest.raises(ValueError):
            list(inflated(iter([whole[:cut]])))
    with pytest.raises(Exception):
        list(inflated(iter([whole[: edge - 6] + b"\1" + whole[edge - 5 :]])))
