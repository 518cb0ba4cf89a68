"""Streaming versions of request scoring and of the running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairsight.operators.categorize import LEFT, RIGHT, RULES, CategoryDictionary, RuleTable, enrich
from pairsight.sources.requests import accepted, decode_requests, rejected


def enrich_requests(requests: DataFrame, body: str, left_dict: CategoryDictionary = LEFT,
                    right_dict: CategoryDictionary = RIGHT, rules: RuleTable = RULES) -> DataFrame:
    """Decode and categorise a stream (or table) of requests; ``valid`` tells rejects apart."""
    return enrich(decode_requests(requests, body), "left_name", "right_name", left_dict, right_dict, rules)


UNTIL_THE_END = {"availableNow": True}


def run_scoring_stream(enriched: DataFrame, score: Callable[[DataFrame], DataFrame], output: str, rejects: str,
                       checkpoint: str, trigger: dict = UNTIL_THE_END) -> StreamingQuery:
    """Score valid requests into one table and write invalid ones to another.

    Batch n is written to its own folder with overwrite, so a batch that runs again after a failure
    replaces its own output. A batch is kept while both tables are written, so it is decoded once. ``trigger`` is
    handed to the stream writer; by default the stream ends with its input.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            score(accepted(batch)).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            rejected(batch).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    return (
        enriched.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def risk_counts(enriched: DataFrame, event_time: str, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Rows per time window and risk level. Rows later than the watermark are dropped.

    State holds one row per open window and level, whatever the number of events.
    """
    return (
        enriched.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window).alias("_w"), "risk_level")
        .agg(F.count("*").alias("n"))
        .select(F.col("_w.start").alias("window_start"), "risk_level", "n")
    )


def run_table_stream(frame: DataFrame, output: str, checkpoint: str, mode: str = "append",
                     trigger: dict = UNTIL_THE_END) -> StreamingQuery:
    """Append closed windows to one Parquet table; a window that is still open when the input ends stays out."""
    return (
        frame.writeStream.format("parquet").outputMode(mode)
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_counts_stream(counts: DataFrame, output: str, checkpoint: str, trigger: dict = UNTIL_THE_END) -> StreamingQuery:
    """Write the windows that changed in each batch, so that open windows, the newest too, are seen at once.

    Batch n has its own folder, overwritten when it runs again. :func:`latest_counts` reads the result.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        counts.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def latest_counts(written: DataFrame) -> DataFrame:
    """The last count written for each window and level."""
    return written.groupBy("window_start", "risk_level").agg(F.max_by("n", "batch").alias("n"))
