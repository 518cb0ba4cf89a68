"""Compatibility of two item lists that belong together (a basket)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_pairs(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Predicted pairs above the threshold."""
    return scores.where(F.col("interaction_predicted") & (F.col("probability") > threshold))


def explode_baskets(baskets: DataFrame, basket: str, lefts: str, rights: str) -> tuple[DataFrame, DataFrame]:
    """Long item tables from a table with two array columns."""
    return (
        baskets.select(basket, F.explode(lefts).alias("left_name")),
        baskets.select(basket, F.explode(rights).alias("right_name")),
    )


def basket_alerts(left_items: DataFrame, right_items: DataFrame, alerts: DataFrame, basket: str,
                  left_key: str, right_key: str) -> DataFrame:
    """Every alerting (left item, right item) of a basket.

    The alert table drives both joins, so only pairs that do alert are built, not all pairs of a
    basket. Keys may be names or categories; with categories the alert table is bounded by the
    dictionaries.
    """
    return left_items.join(alerts, left_key).join(right_items, [basket, right_key])


def basket_compat(left_items: DataFrame, right_items: DataFrame, alerts: DataFrame, basket: str,
                  left_key: str, right_key: str) -> DataFrame:
    """One row per basket: number of alerting pairs, safe flag, message.

    Items are counted per (basket, key) first; a basket's number of alerting pairs is the sum of
    products of those counts. A basket that holds a large part of all rows shrinks to one row per
    key before anything is joined.
    """
    lefts = left_items.groupBy(basket, left_key).agg(F.count("*").alias("_nl"))
    rights = right_items.groupBy(basket, right_key).agg(F.count("*").alias("_nr"))
    keys = alerts.groupBy(left_key, right_key).agg(F.count("*").alias("_na"))
    found = (
        lefts.join(keys, left_key).join(rights, [basket, right_key])
        .groupBy(basket).agg(F.sum(F.col("_nl") * F.col("_nr") * F.col("_na")).alias("_found"))
    )
    everyone = lefts.select(basket).union(rights.select(basket)).distinct()
    n = F.coalesce(F.col("_found"), F.lit(0)).cast("bigint")
    return everyone.join(found, basket, "left").select(
        basket, (n == 0).alias("safe"), n.alias("n_interactions"),
        F.concat(F.lit("Found "), n.cast("string"), F.lit(" potential interactions")).alias("recommendations"))
