"""Equal-size shards by sampled splitters.

A record's key is (text checksum, id, row number). Keys are sampled with a chance in
proportion to the record's size, quantiles of the sample become the splitters of many
more ranges than shards, and every record is put into its range. The ranges' exact sizes
are summed; a range over twice its share is sampled again and subdivided, until none is
left that more splitters could divide. Inside a range a window adds up the records before
each one, the sizes of the ranges before are added, and the sum decides the shard: shard s
takes the records at which less than (s + 1) / n of all bytes have gone by. So sizes differ
by less than one record from equal shares, whatever the sample was; it only balances tasks.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, named, staged

_KEY = ["text_crc32", "id_key", "row_number"]
_LEAST = -(1 << 63)


def _sortable(*columns) -> np.ndarray:
    """Keys of signed 64-bit columns as byte strings in the same order."""
    stacked = np.stack([np.asarray(c, np.int64) for c in columns], axis=1)
    flipped = (stacked.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
    # A closing byte keeps numpy from taking trailing zero bytes for padding.
    return np.concatenate([flipped.view(np.uint8).reshape(len(stacked), -1), np.ones((len(stacked), 1), np.uint8)], axis=1).view(f"S{8 * len(columns) + 1}")[:, 0]


def range_of(splitters: list[tuple]):
    """A column function: number of the range that a key falls into."""
    edges = _sortable(*zip(*splitters)) if splitters else np.zeros(0, "S25")

    @F.pandas_udf("int")
    def place(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _sortable(a, b, c), "right").astype(np.int32))

    return place(*_KEY)


def _splitters(sample: list[tuple], pieces: int) -> list[tuple]:
    """Keys at the weighted quantiles of a sorted sample of (key, weight)."""
    total = np.cumsum([w for _, w in sample])
    at = np.searchsorted(total, total[-1] * np.arange(1, pieces) / pieces, "right") if sample else []
    return sorted({sample[i][0] for i in at if i < len(sample)})


def _sampled(rows: DataFrame, wanted: int, seed: int) -> list:
    """Rows (with ``all``, their range's bytes) drawn with a chance of wanted * size / all, seeded by the row number."""
    chance = F.pmod(F.xxhash64(F.lit(seed), "row_number"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.where(chance < wanted * F.col("size") / F.col("all"))
    return drawn.select(*_KEY, "size", "all").orderBy(*_KEY).collect()  # about ``wanted`` rows for each range sampled


def shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", per_range: int = 32,
           seed: int = 17, carried: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard, a row per input row, and ``row`` with the carried columns.

    Size is the text's UTF-8 bytes plus 8. A null text has no bytes and the checksum of
    none (0). Null ids come before others of the same checksum; repeated rows each have a
    place. Shards may be empty where there are fewer rows than shards. ``law`` is ``bytes``,
    so ``grown_shard`` is null. Columns that are not carried are not read.
    """
    spark = docs.sparkSession
    text = named(text_col, "text")
    row = [F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row")] if carried else []
    lean = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), *row)
    lean = lean.withColumn("id_key", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("row_number", F.monotonically_increasing_id())
    lean = staged(lean, "records")  # row numbers are fixed from here on
    keys = lean.select(*_KEY, "size")
    all_bytes = keys.agg(F.sum("size")).first()[0] or 1
    n_ranges = max(8 * n_shards, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    drawn = _sampled(keys.withColumn("all", F.lit(all_bytes)), n_ranges * per_range, seed)
    splitters = _splitters([((r[0], r[1], r[2]), max(r["size"], all_bytes / (n_ranges * per_range))) for r in drawn], n_ranges)
    share = all_bytes / n_ranges
    while True:
        totals = keys.withColumn("range", range_of(splitters)).groupBy("range").agg(F.sum("size").alias("all"), F.count("*").alias("n"))
        totals = {r["range"]: r for r in totals.collect()}  # a row per range
        over = {k: r["all"] for k, r in totals.items() if r["all"] > 2 * share and r["n"] > 1}
        if not over:
            break
        sizes = F.create_map(*[F.lit(x) for kv in over.items() for x in kv])
        inside = keys.withColumn("all", sizes[range_of(splitters)]).where("all is not null")
        seed += 1
        by_range: dict[int, list] = {}
        for r in _sampled(inside, 2 * per_range, seed):
            by_range.setdefault(bisect_right(splitters, (r[0], r[1], r[2])), []).append(((r[0], r[1], r[2]), max(r["size"], r["all"] / (2 * per_range))))
        finer = {s for k, sample in by_range.items() for s in _splitters(sample, int(over[k] / share) + 1)}
        if finer <= set(splitters):
            break
        splitters = sorted(finer | set(splitters))

    before, ranges = 0, []
    for k in sorted(totals):
        ranges.append((k, before))
        before += totals[k]["all"]
    offsets = spark.createDataFrame(ranges, "range int, bytes_before long")
    in_range = Window.partitionBy("range").orderBy(*_KEY)
    placed = lean.withColumn("range", range_of(splitters)).repartition(max(1, len(ranges)), "range")
    placed = placed.withColumn("bytes_in", F.sum("size").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = placed.join(F.broadcast(offsets), "range")  # a row per range
    placed = placed.withColumn("shard", F.floor((F.col("bytes_before") + F.col("bytes_in")).cast("decimal(38,0)") * n_shards / F.lit(all_bytes)).cast("int"))
    records, placed = lean, staged(placed.drop("bytes_before", "bytes_in", "id_key"), "placed")
    discard(records)
    counts = sorted((r["shard"], r["range"], r["count"]) for r in placed.groupBy("shard", "range").count().collect())  # fewer than ranges + shards rows
    firsts, at = [], {}
    for s, k, n in counts:
        firsts.append((s, k, at.get(s, 0)))
        at[s] = at.get(s, 0) + n
    firsts = spark.createDataFrame(firsts, "shard int, range int, first long")
    in_shard = Window.partitionBy("range", "shard").orderBy("text_crc32", F.col("doc_id").asc_nulls_first(), "row_number")
    slot = placed.withColumn("own", F.row_number().over(in_shard) - 1).join(F.broadcast(firsts), ["shard", "range"])
    return slot.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("own")).cast("long").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"), *(["row"] if carried else []))
