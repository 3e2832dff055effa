"""Query registry: name -> (Spark builder, DuckDB oracle text or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    check: str  # "D" full oracle, "I" invariant table, "R" rows only


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None, check: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, oracle, check or ("D" if oracle else "R"))
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_evaluate, q_explain, q_features, q_models, q_population, q_profile, q_segments, q_sources, q_stats, q_streaming)
    return REGISTRY
