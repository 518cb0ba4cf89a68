"""Broadcast decisions from measured sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a narrow table (a key and a few short columns) that are safe to send to every executor.
MAX_BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a row count that was measured; otherwise Spark's own choice stands."""
    return F.broadcast(df) if rows <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a plain scan at least as many tasks as there are cores.

    A file with one row group is one task. Scans with enough splits, as any large input has, are
    left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
