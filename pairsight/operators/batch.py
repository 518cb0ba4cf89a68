"""Scoring every left name against every right name, in left-major order, with a cap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.plans.shared import write_once
from pairsight.plans.sizing import broadcast_if_small


def combinations(left: DataFrame, right: DataFrame, cap: int | None = 100) -> DataFrame:
    """Combination rows ``(combo_id, left_name, right_name)`` of two ``(position, name)`` lists.

    The k-th combination is (k div n, k mod n), so the list is a range joined twice on position:
    there is no cross join, and with a cap only the combinations asked for are ever built.
    """
    spark = left.sparkSession
    left, right = write_once(left, "left-list"), write_once(right, "right-list")
    n_left, n_right = left.count(), right.count()
    total = n_left * n_right if cap is None else min(cap, n_left * n_right)
    ids = spark.range(total).select(
        F.col("id").alias("combo_id"),
        F.floor(F.col("id") / F.lit(max(n_right, 1))).cast("bigint").alias("_l"),
        (F.col("id") % F.lit(max(n_right, 1))).alias("_r"),
    )
    lefts = left.select(F.col("position").alias("_l"), F.col("name").alias("left_name"))
    rights = right.select(F.col("position").alias("_r"), F.col("name").alias("right_name"))
    return (
        ids.join(broadcast_if_small(lefts, n_left), "_l")
        .join(broadcast_if_small(rights, n_right), "_r")
        .select("combo_id", "left_name", "right_name")
    )


def summary_by_category(left: DataFrame, right: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The summary over all combinations of two ``(name, category)`` lists, without building them.

    The outcome depends on the two categories only, so names are counted per category, the few category pairs
    are scored by ``score`` (which appends ``interaction_predicted``), and the counts are multiplied.
    """
    lefts = left.groupBy(F.col("category").alias("left_category")).agg(F.count("*").alias("_nl"))
    rights = right.groupBy(F.col("category").alias("right_category")).agg(F.count("*").alias("_nr"))
    # One row per category on either side: both are bounded by the dictionaries.
    every = lefts.agg(F.collect_list(F.struct("left_category", "_nl")).alias("_l")).select(F.explode("_l").alias("_l"))
    listed = rights.agg(F.collect_list(F.struct("right_category", "_nr")).alias("_r"))
    grid = every.join(F.broadcast(listed)).select("_l.*", F.explode("_r").alias("_r")).select("left_category", "_nl", "_r.*")
    n = F.col("_nl") * F.col("_nr")
    return score(grid).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("total_combinations"),
        F.coalesce(F.sum(F.when(F.col("interaction_predicted"), n)), F.lit(0)).alias("interactions_found"))


def batch_summary(scored: DataFrame, predicted: str = "interaction_predicted") -> DataFrame:
    return scored.agg(
        F.count("*").alias("total_combinations"),
        F.count_if(F.col(predicted)).alias("interactions_found"),
    )
