"""WARC archives: writing them, normalising whole-file gzip, and reading by an index.

Some archives are one gzip stream over all records, so that a reader must inflate
everything before the record it wants. The normaliser inflates such a stream once, piece
by piece, writes every record as a gzip member of its own and a sidecar index with a line
``offset length type`` for each. With the index any record is one short read, and a
large archive can be read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from itertools import chain
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_shared, staged, write_shared
from ..session import scratch_path

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
_PIECE = 1 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_DATE = "1970-01-01T00:00:00Z"  # the table has no time of capture


def _b32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP headers only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7F]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{_b32(digest)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def inflated(pieces: Iterator[bytes], most: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or many, at most ``most`` at once. A file
    that ends before its last member does (checksum included) raises a ValueError."""
    z, begun = zlib.decompressobj(31), False
    for piece in chain(pieces, [b""]):
        full = True
        while piece or (begun and full):
            out = z.decompress(piece, most)
            begun, full = True, len(out) == most
            if out:
                yield out
            piece = z.unconsumed_tail
            if z.eof:
                piece, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("archive ends inside a gzip member")


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """The raw records of an inflated archive, one at a time."""
    held = bytearray()
    more = iter(stream)

    def reach(n: int) -> bool:
        while len(held) < n:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not reach(len(held) + 1):
                if held:
                    raise ValueError("archive ends inside a record")
                return
            at = held.find(b"\r\n\r\n")
        size = re.search(rb"(?mi)^content-length:\s*(\d+)", held[:at])
        end = at + 4 + int(size[1]) + 4
        if not reach(end):
            raise ValueError("archive ends inside a record")
        yield bytes(held[:end])
        del held[:end]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one whole-file gzip archive per task; path and n_records of each.

    Of rows with equal payloads of at least ``LEAST_SHARED`` bytes those with the largest
    id are responses and the others revisits of it; all others are responses.
    """
    taken = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.encode(F.col(f"`{html_col}`"), "UTF-8"), F.lit(b"")).alias("payload"))
    hashed = taken.withColumn("digest", F.sha1("payload"))
    lean = staged(hashed.select("page_id", "digest", F.octet_length("payload").alias("bytes")).where(f"bytes >= {LEAST_SHARED}"), "payloads")
    groups = lean.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    again = lean.join(groups, "digest").where("page_id is null or page_id != refers_to")
    again = staged(again.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), "refers_to").distinct(), "revisits")
    rows = hashed.join(again, hashed.page_id.eqNullSafe(again.id) & (hashed.digest == again.d), "left").select("page_id", "url", "payload", "refers_to", "digest")

    def run(batches):
        n = 0

        def write(out):
            nonlocal n
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            for batch in batches:
                for row in zip(*(c for c in batch.columns)):
                    out.write(z.compress(record(*(x.as_py() for x in row))))
                    n += 1
            out.write(z.flush())

        path = write_shared(f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", write)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "n_records"])

    return staged(rows.mapInArrow(run, "path string, n_records long"), "archives")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive with a member per record and writes ``<archive>.idx``; path, index and n_records.

    An archive is inflated once, by one task, and never held whole: a record at a time is.
    """

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                fs, place = open_shared(source)
                lines, offset = [], 0

                def pieces(fs=fs, place=place):
                    with fs.open_input_stream(place, compression=None) as f:
                        while piece := f.read(_PIECE):
                            yield piece

                def write(out):
                    nonlocal offset
                    for raw in records(inflated(pieces())):  # noqa: B023
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        kind = re.search(rb"(?mi)^warc-type:\s*(\S+)", raw)[1].decode()
                        lines.append(f"{offset} {len(member)} {kind}\n")  # noqa: B023
                        offset += len(member)

                target = f"{folder}/{place.rsplit('/', 1)[1]}"
                write_shared(target, write)
                write_shared(f"{target}.idx", lambda out: out.write("".join(lines).encode()))  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.idx"]), pa.array([len(lines)], pa.int64())], ["path", "index", "n_records"])

    n = max(1, archives.count())
    return staged(archives.repartition(n).mapInArrow(run, "path string, index string, n_records long"), "normalised")


def read_archives(folder: str, spark) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record that the indexes name."""
    lines = spark.read.text(folder, pathGlobFilter="*.idx").select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("path"), F.split("value", " ").alias("v"))
    entries = lines.select("path", F.col("v")[0].cast("long").alias("offset"), F.col("v")[1].cast("long").alias("length"))

    def page(urn: str | None) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
        return int(number) if number else None

    def run(batches):
        name, file = None, None
        for batch in batches:
            out = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if path != name:
                    fs, place = open_shared(path)
                    name, file = path, fs.open_input_file(place)
                fields, block = parse(zlib.decompress(file.read_at(length, offset), 31))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = fields["warc-type"]
                if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"payload differs from its digest: {path} at {offset}")
                out.append((page(fields["warc-record-id"]), size, digest, kind, page(fields.get("warc-refers-to"))))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return entries.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes whole-file archives, normalises them and reads them back, a row per page.

    A null html is an empty payload. A row with a null id is never what others refer to,
    and is a revisit where its payload is shared with a row that has an id. Repeated rows
    of the largest id are all responses. Other columns are not read. An empty table gives
    archives without records.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    written = write_archives(pages, f"{folder}/whole", id_col, url_col, html_col)
    if normalise(written, f"{folder}/members").isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_archives(f"{folder}/members", spark)


ORACLE = f"""WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS payload_bytes, sha1(COALESCE(html, '')) AS payload_digest FROM pages),
 g AS (SELECT payload_digest, MAX(page_id) AS top FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY 1 HAVING COUNT(*) > 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p LEFT JOIN g USING (payload_digest)"""
