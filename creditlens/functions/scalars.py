"""One-row statistics used inside row expressions.

A fitted statistic (a total, a cap, a range) is a one-row aggregate.  Instead
of joining it onto the data it becomes a scalar subquery: Spark runs the
aggregate once (partial aggregation, one tiny result), reuses it for every
reference, and inlines the value into the consuming stage as a literal — the
big side is never joined, shuffled or replicated.

Per-series statistics (one row per model / class / series key) are attached by
an equi-join on the keys; those tables hold one row per series, which is
bounded by the number of series, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_values(stats: DataFrame) -> dict[str, Column]:
    """The columns of a one-row frame as values usable in any expression
    (one subquery for all of them; null when the frame is empty)."""
    st = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("_st")).scalar()
    return {c: st[c] for c in stats.columns}


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``df`` with the columns of the one-row frame ``stats`` appended."""
    return df.select("*", *[v.alias(c) for c, v in scalar_values(stats).items()])


def with_series_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach per-series statistics: broadcast equi-join on the series keys
    (one stats row per series), or scalar values when there are no keys."""
    keys = list(keys)
    if keys:
        return df.join(F.broadcast(stats), keys, "inner")
    return with_scalars(df, stats)
