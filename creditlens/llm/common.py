"""Helpers shared by the corpus operators: staged tables, shared files, Arrow text blocks."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text that one vectorised step takes at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
BLOCK_ROWS = 4096


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Staged tables that are still there.
_STAGED: set[str] = set()


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once (with the writer's ``options``) as Parquet in the shared folder and read back: the lineage
    is cut, and a lost executor costs a reread of files instead of a recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    _STAGED.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared folder, for files that tasks write themselves."""
    path = scratch_path(spark, name)
    fs, place = open_shared(path)
    fs.create_dir(place, recursive=True)
    _STAGED.add(path)
    return path


def _delete(path: str) -> None:
    _STAGED.discard(path)
    fs, place = open_shared(path)
    fs.delete_dir(place)


def discard(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again, and the folder of files (``files_at``) that it names."""
    for path in filter(None, (df.staged_at, getattr(df, "files_at", None))):
        _delete(path)


def in_turn(before, stage):
    """``stage`` (spark, docs, sf_dir), called with what the stage ``before`` (made by this function,
    or None) gave, once that is written. The tables that ``before`` has staged for its result are
    deleted then, but for those that ``docs`` itself still reads."""

    @functools.wraps(stage)
    def call(spark, docs, sf_dir):
        if before is not None and before.tables:
            read = docs.inputFiles()
            done = {t for t in before.tables if not any(t.rsplit("/", 1)[1] in f for f in read)}
            before.tables -= done
            for path in done & _STAGED:
                _delete(path)
        there = set(_STAGED)
        out = stage(spark, docs, sf_dir)
        call.tables |= _STAGED - there
        return out

    call.tables = set()
    return call


def open_shared(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a file in the shared folder (``file:``, ``hdfs:``, ``s3:`` ... or a plain path)."""
    return pafs.FileSystem.from_uri(path)


def write_shared(path: str, write) -> str:
    """``write(stream)`` to a file of its own and rename it to ``path``: a task that is
    run twice, or dies half-way, never leaves a partial file under the final name."""
    fs, place = open_shared(path)
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(draft, compression=None) as out:
        write(out)
    fs.move(draft, place)
    return path


def named(column: str, default: str):
    """``column`` of a DataFrame as ``default``, quoted so that odd names stay plain names."""
    return F.col(f"`{column}`").alias(default)


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null has no bytes."""
    if pa.types.is_large_string(array.type):
        kind = np.int64
    else:
        array, kind = array.cast(pa.string()), np.int32
    if array.null_count:
        array = array.fill_null("")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data, offsets


def text_blocks(array: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``most`` bytes, ``BLOCK_ROWS`` rows at most."""
    data, offsets = string_buffers(array)
    lo = 0
    while lo < len(offsets) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1), lo + BLOCK_ROWS)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
