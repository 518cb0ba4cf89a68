"""Connected components of a stored link table, by rounds of contraction.

In a round each vertex points at its neighbour of least priority (a hash of the id, then the id), unless its own
is less; links are then drawn between the vertices pointed at, and links inside one vertex go. Vertices shrink
by a constant share a round whatever the shape of the graph. Every round is stored, so lost executors
cost no more than their tasks; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.plans.shared import write_once


def _priority(column: str):
    return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("id"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b); the root is the least id of the component."""
    current = write_once(links.select("a", "b").where("a <> b").distinct(), "links")
    result = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_priority("b")).alias("least"))
        pointed = write_once(least.select(F.col("a").alias("id"), F.least("least", _priority("a"))["id"].alias("to")), "pointed")
        if result is None:
            result = pointed
        else:
            step = pointed.select(F.col("id").alias("to"), F.col("to").alias("next"))
            result = result.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        ends = [pointed.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab"]
        moved = current.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        current = write_once(moved.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
        if current.isEmpty():
            break
    result = write_once(result, "members")
    roots = result.groupBy("to").agg(F.min("id").alias("root"))
    return result.join(roots, "to").select("id", "root")
