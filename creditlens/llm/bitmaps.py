"""Sets of 64-bit keys as bitmaps of a fixed size, kept in the shared folder.

A clear bit proves that a key is not in the set; a set bit proves nothing, so callers
use a bitmap only to leave out work early and decide by exact keys later. A bitmap has
``2 ** bits`` bits whatever the size of the set, and tasks read it from the shared
folder, so nothing that grows with the data is broadcast or passes through the driver.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow.dataset as pads
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_shared, staged

#: Bits in a stored row, as a power of two.
_ROW = 15


def bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """A staged table of chunk and set bits for the keys in the only column of ``keys``."""
    cell = F.shiftrightunsigned(F.col(keys.columns[0]), 64 - bits)
    cells = keys.select(F.shiftright(cell, _ROW).cast("int").alias("chunk"), F.expr(f"CAST({2**_ROW - 1} AS INT)").bitwiseAND(cell.cast("int")).alias("bit"))
    return staged(cells.groupBy("chunk").agg(F.collect_set("bit").alias("bits")), "bitmap")


@lru_cache(maxsize=4)
def loaded(path: str, bits: int) -> np.ndarray:
    """The packed bits of a staged bitmap, read once by each worker."""
    fs, place = open_shared(path)
    out = np.zeros(1 << bits >> 3, np.uint8).reshape(-1, 1 << _ROW >> 3)
    for batch in pads.dataset(place, filesystem=fs, format="parquet").to_batches():
        for chunk, on in zip(batch.column("chunk").to_pylist(), batch.column("bits")):
            row = np.zeros(1 << _ROW, bool)
            row[on.values.to_numpy()] = True
            out[chunk] = np.packbits(row, bitorder="little")
    return out.ravel()


def may_hold(packed: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """For unsigned keys: False where a key is surely not in the set."""
    cell = keys >> np.uint64(64 - bits)
    return (packed[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
