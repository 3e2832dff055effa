"""Reading the driver's Parquet tables (column pruning and filters reach the scan)."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """``spark.read.parquet`` of one table; ``columns`` prunes the scan's ReadSchema."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def scale_factor(sf_dir: str, default: float = 0.1) -> float:
    """Scale factor encoded in a directory name such as ``.../sf0.01``."""
    m = re.search(r"sf([0-9.]+)", os.path.basename(os.path.normpath(sf_dir)))
    return float(m.group(1)) if m else default
