"""Global order without a global sort: cutoffs, dense positions and running totals.

A window without PARTITION BY, or with a handful of hot partitions, runs in one task. Everything
here splits the order into buckets first, sums the buckets (a table of bounded size), and does
row-level work only inside single buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.plans.shared import write_once

HEX_DIGITS = 3          # 4,096 buckets over a hex key
RANGE_BUCKETS = 256     # buckets over a numeric order


def hex_bucket(key: Column, digits: int = HEX_DIGITS) -> Column:
    """Order-preserving bucket of a uniformly spread hex key."""
    return F.substring(key, 1, digits)


def first_k_cutoffs(df: DataFrame, group: list[str], key: str, bucket: Column, take: Column) -> DataFrame:
    """Per group, the key value of the k-th row in key order: ``(group…, _cutoff, _all, _none)``.

    ``take`` gives k as an expression over ``_total``, the group's row count. Keys must be unique
    within a group. Only the single bucket that holds the k-th row is ever sorted.
    """
    rows = df.select(*group, F.col(key).alias("_key"), bucket.alias("_bucket"))
    # Small (buckets x groups) and needed twice, so it is stored.
    counts = write_once(rows.groupBy(*group, "_bucket").agg(F.count("*").alias("_n")), "bucket-counts")
    by_group = W.partitionBy(*group)
    running = by_group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        counts.withColumn("_total", F.sum("_n").over(by_group))
        .withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_k", take.cast("bigint"))
    )
    whole = placed.groupBy(*group).agg(
        F.first("_k").alias("_k"), F.first("_total").alias("_total"))
    edge = placed.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k"))).select(
        *group, "_bucket", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_local"))
    in_edge = rows.join(F.broadcast(edge), [*group, "_bucket"])  # at most one bucket per group
    position = F.row_number().over(W.partitionBy(*group, "_bucket").orderBy("_key"))
    cut = in_edge.withColumn("_pos", position).where(F.col("_pos") == F.col("_local")).select(
        *group, F.col("_key").alias("_cutoff"))
    return whole.join(cut, group, "left").select(
        *group, "_cutoff", (F.col("_k") >= F.col("_total")).alias("_all"), (F.col("_k") <= 0).alias("_none"))


def mark_first_k(df: DataFrame, group: list[str], key: str, bucket: Column, take: Column, flag: str) -> DataFrame:
    """Append a boolean that is true for the first k rows of each group in key order.

    The groups are strata (classes, a constant): their number is small, so the cutoffs are sent to
    every task and the rows themselves are not shuffled.
    """
    cutoffs = first_k_cutoffs(df, group, key, bucket, take)
    chosen = ~F.col("_none") & (F.col("_all") | (F.col(key) <= F.col("_cutoff")))
    marked = df.join(F.broadcast(cutoffs), group, "left")
    return marked.withColumn(flag, F.coalesce(chosen, F.lit(False))).drop("_cutoff", "_all", "_none")


def dense_position(df: DataFrame, key: str, position: str, digits: int = HEX_DIGITS) -> DataFrame:
    """Append 0-based positions in the order of ``md5(key), key`` over unique keys.

    Bucket sizes come from the hash prefix, so buckets are even however the keys are distributed.
    """
    hashed = df.withColumn("_hash", F.md5(F.col(key).cast("string"))).withColumn("_bucket", hex_bucket(F.col("_hash"), digits))
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))  # <= 16**digits rows
    local = F.row_number().over(W.partitionBy("_bucket").orderBy("_hash", key))
    return (
        hashed.join(F.broadcast(offsets), "_bucket")
        .withColumn(position, (local - 1 + F.col("_offset")).cast("bigint"))
        .drop("_hash", "_bucket", "_offset")
    )


def with_range_bucket(df: DataFrame, order: str, buckets: int = RANGE_BUCKETS, rows_per_bucket: int = 100_000) -> DataFrame:
    """Append ``_bucket`` by approximate quantiles of a numeric column, at least ``buckets`` of them.

    One pass over a stored table finds the bounds and the number of rows, so that no bucket holds much more than
    ``rows_per_bucket`` distinct values, however many there are. The bounds are found first and then fixed.
    """
    n = df.count()
    wanted = max(buckets, 2, -(-n // rows_per_bucket))
    points = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
    bounds = df.agg(F.array_distinct(F.percentile_approx(order, points, F.lit(10 * wanted)))).head()[0] or []
    edges = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
    return df.withColumn("_edges", edges).withColumn(
        "_bucket", F.size(F.filter("_edges", lambda b: b < F.col(order)))).drop("_edges")


def running_totals(df: DataFrame, order: str, columns: list[str], buckets: int = RANGE_BUCKETS) -> DataFrame:
    """Inclusive running sums in descending order of a unique numeric column.

    Appends ``cum_<c>`` and ``all_<c>`` (the grand total) for each column.
    """
    bucketed = with_range_bucket(df, order, buckets)
    sums = bucketed.groupBy("_bucket").agg(*[F.sum(c).alias(f"_sum_{c}") for c in columns])
    above = W.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)  # <= `buckets` rows
    everything = W.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = sums.select(
        "_bucket",
        *[F.coalesce(F.sum(f"_sum_{c}").over(above), F.lit(0)).alias(f"_above_{c}") for c in columns],
        *[F.sum(f"_sum_{c}").over(everything).alias(f"all_{c}") for c in columns],
    )
    inside = W.partitionBy("_bucket").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = bucketed.join(F.broadcast(offsets), "_bucket")
    return joined.withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"_above_{c}") for c in columns}).drop(
        *[f"_above_{c}" for c in columns])
