"""Token ids in binary files with Elias-Fano document boundaries.

One file holds the documents of one range of ids: all token ids of the range one
after the other as little-endian unsigned integers of 16 bits where the vocabulary has
no more than 65,536 ids, else of 32 (the footer tells), then two Elias-Fano sequences,
the documents' ends and their ids (less the smallest), and a footer.
An Elias-Fano sequence of n values up to u keeps floor(log2(u / n)) low bits of
each value as they are and the rest in unary, about 2 + log2(u / n) bits each. In
memory a rank is kept for every ``SAMPLE`` bytes of the unary part, and select gives
any value, or values in a row, from there on without decoding the rest.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import named, open_shared, staged, text_blocks, write_shared
from ..session import scratch_path

MAGIC = b"TOKEF001"
#: Bytes of the unary part for which one rank is kept, for select.
SAMPLE = 256
#: Values packed at once; a multiple of 8, so that each piece starts on a whole byte.
_STEP = 1 << 16


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.add.reduceat(np.bitwise_count(high), np.arange(0, len(high), SAMPLE), dtype=np.int64) if len(high) else np.zeros(0, np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)])  # set bits before each sample

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        place, low = np.arange(low_bits, dtype=np.uint64), [np.zeros(0, np.uint8)]
        for a in range(0, n, _STEP):
            bits = (values[a : a + _STEP, None] >> place) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        low = np.concatenate(low)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, low_bits, low, high)

    def select(self, i: int) -> int:
        """Value number ``i``."""
        return int(self.between(i, i + 1)[0])

    def between(self, a: int, b: int) -> np.ndarray:
        """Values number ``a`` to ``b`` - 1, from the sampled bytes of the unary part that hold them."""
        if not 0 <= a < b <= self.n:
            raise IndexError((a, b))
        first = int(np.searchsorted(self.ranks, a, "right")) - 1
        last = int(np.searchsorted(self.ranks, b - 1, "right"))
        ones = np.flatnonzero(np.unpackbits(self.high[first * SAMPLE : last * SAMPLE], bitorder="little"))
        ones = ones[a - int(self.ranks[first]) :][: b - a] + first * SAMPLE * 8
        return ((ones - np.arange(a, b)) << self.low_bits) | self._low(a, b)

    def first_above(self, value: int) -> int:
        """How many values are at most ``value``, by bisection over select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.select(mid) <= value else (lo, mid)
        return lo

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.int64)
        first = a * self.low_bits
        piece = np.unpackbits(self.low[first // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[first % 8 :]
        piece = piece[: (b - a) * self.low_bits].reshape(b - a, self.low_bits).astype(np.int64)
        return (piece << np.arange(self.low_bits)).sum(axis=1)

    def to_bytes(self) -> bytes:
        return np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8").tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = np.frombuffer(data[:32], "<i8").tolist()
        return cls(n, low_bits, np.frombuffer(data, np.uint8, a, 32), np.frombuffer(data, np.uint8, b, 32 + a))


class WordEncoder:
    """Ids of whole texts under a ``tokenizers`` file whose tokens never reach over white space.

    Each run between ASCII white space is encoded once per worker and remembered, and a
    text's ids are those of its runs in turn. That needs a normaliser and splitter that
    treat white space only as a separator, as the word-end vocabulary does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memory = words.TokenMemory(slots=22, most=16 << 20)  # two million words, 140 MB at most

    def _encode(self, texts: list[str]) -> tuple[list[int], np.ndarray]:
        found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return found.ids, np.bincount(np.array(found.word_ids, np.int64), minlength=len(texts))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and where each text's ids start (and the end)."""
        starts, ends, rows = words.spans(data, offsets, words.SPACED)
        h = words.hashes(data, starts, ends, folded=False)
        flat, size = self.memory.tokens(data, starts, ends, h, self._encode)
        return flat, np.concatenate([[0], np.cumsum(size)])[rows]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; what it remembers serves all tasks that the worker runs."""
    return WordEncoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest: part, path, n_docs, n_tokens.

    Documents are range-partitioned by id (nulls first), one file a range, and a file
    is written as its documents stream through the task.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = docs.select(named(id_col, "doc_id").cast("long").alias("doc_id"), named(text_col, "text"))
    ranged = taken.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"))

    def run(batches):
        part = TaskContext.get().partitionId()
        ids, ends, total = [], [], 0

        def write(out):
            nonlocal total
            words_of = encoder(tokenizer)
            for batch in batches:
                for lo, hi, data, offsets in text_blocks(batch.column(1)):
                    flat, at = words_of.ids(data, offsets)
                    own = np.insert(flat, at[1:], end_id).astype(f"<u{words_of.width}")
                    out.write(own.tobytes())
                    ends.append(total + at[1:] + np.arange(1, hi - lo + 1))
                    ids.extend(batch.column(0).slice(lo, hi - lo).to_pylist())
                    total += len(own)
            nulls = sum(i is None for i in ids)
            keys = np.array(ids[nulls:], np.int64)
            base = int(keys[0]) if len(keys) else 0
            blobs = [EliasFano.encode(np.concatenate(ends) if ends else []).to_bytes(), EliasFano.encode((keys - base).view(np.uint64)).to_bytes()]
            footer = json.dumps({"width": words_of.width, "tokens": total, "docs": len(ids), "null_ids": nulls, "base_id": base, "ends": len(blobs[0]), "ids": len(blobs[1])}).encode()
            out.write(b"".join(blobs) + footer + len(footer).to_bytes(4, "little") + MAGIC)

        path = write_shared(f"{folder}/part-{part:06d}.tok", write)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    return staged(ranged.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "manifest")


class TokenFile:
    """A file of the format: token ids by document number, read in place."""

    def __init__(self, path: str):
        fs, place = open_shared(path)
        self.file = fs.open_input_file(place)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a token file: {path}")
        n = int.from_bytes(tail[:4], "little")
        self.info = json.loads(self.file.read_at(n, size - 12 - n))
        self.kind = f"<u{self.info['width']}"
        at = self.info["width"] * self.info["tokens"]
        self.ends = EliasFano.from_bytes(self.file.read_at(self.info["ends"], at))
        self.ids = EliasFano.from_bytes(self.file.read_at(self.info["ids"], at + self.info["ends"]))

    def __len__(self) -> int:
        return self.info["docs"]

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Ids of documents number ``a`` to ``b`` - 1."""
        nulls = self.info["null_ids"]
        lo, hi = max(a, nulls) - nulls, b - nulls
        return [None] * (min(b, nulls) - min(a, nulls)) + ((self.ids.between(lo, hi) + self.info["base_id"]).tolist() if lo < hi else [])

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Where the tokens of documents number ``a`` to ``b`` - 1 start, and the end."""
        return np.concatenate([[0], self.ends.between(0, b)]) if a == 0 else self.ends.between(a - 1, b)

    def tokens(self, i: int) -> np.ndarray:
        """Ids of document number ``i``, through select."""
        lo, hi = self.bounds(i, i + 1)
        return self.slice(int(lo), int(hi))

    def slice(self, lo: int, hi: int) -> np.ndarray:
        width = self.info["width"]
        return np.frombuffer(self.file.read_at(width * (hi - lo), width * lo), self.kind).astype("<u4")


def read_token_files(manifest: DataFrame, most: int = 1 << 22) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    spread = files.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, lo = TokenFile(path), 0
                while lo < len(f):
                    # As many documents as end within ``most`` ids and _STEP documents, one at least.
                    begin = int(f.bounds(lo, lo + 1)[0])
                    hi = min(max(lo + 1, f.ends.first_above(begin + most)), lo + _STEP)
                    at = f.bounds(lo, hi)
                    piece = memoryview(f.slice(begin, int(at[-1]))).cast("B")
                    crc = [zlib.crc32(piece[4 * (a - begin) : 4 * (b - begin)]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids(lo, hi), pa.int64()), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
                    lo = hi

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` as token files and reads them back, a row per input row.

    A null or empty text has the end id only. Null ids come first; rows that share an id
    stand next to each other in the order of their texts' checksums. Other columns of the
    input are not read.
    """
    return read_token_files(write_token_files(docs, tokenizer, end_id, id_col, text_col))
