"""Synthetic pairs for trying things out when there is no pair file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.functions.hashing import u60


def synthetic_pairs(spark: SparkSession, n: int | None = None, left: list[str] = V.SYNTHETIC_LEFT,
                    right: list[str] = V.SYNTHETIC_RIGHT, seed: int = 42) -> DataFrame:
    """n random pairs of the given names; row i is the same under any partitioning."""
    n = len(left) * V.SYNTHETIC_REPEATS if n is None else n
    return pairs_for_ids(spark.range(n), left, right, seed)


def pairs_for_ids(ids: DataFrame, left: list[str], right: list[str], seed: int = 42) -> DataFrame:
    """A pair of names for each ``id``, drawn by hash."""
    def pick(names: list[str], side: str):
        index = (u60(F.lit(seed), F.lit(side), F.col("id")) % F.lit(len(names))).cast("int")
        return F.get(F.array(*[F.lit(n) for n in names]), index)

    return ids.select("id", pick(left, "left").alias("drug"), pick(right, "right").alias("food"))
