"""Cleaning raw pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.functions.text import clean_text


def clean_pairs(raw: DataFrame, left: str, right: str, dedup_after_clean: bool = False,
                min_length: int = 3) -> DataFrame:
    """Drop nulls, de-duplicate on the raw text, clean both names, drop short ones, label with 1.

    De-duplication precedes cleaning, so two spellings that clean to one name stay two rows;
    ``dedup_after_clean`` removes those too.
    """
    pairs = raw.select(F.col(left).alias("left_name"), F.col(right).alias("right_name")).na.drop()
    pairs = pairs.dropDuplicates(["left_name", "right_name"])
    names = ("left_name", "right_name")
    cleaned = F.struct(*[clean_text(F.col(c)).alias(c) for c in names])

    def long_enough(row):
        return (F.char_length(row[names[0]]) >= min_length) & (F.char_length(row[names[1]]) >= min_length)

    # Filtering a one-element array keeps the optimizer from pushing the test below the cleaning,
    # which would run every regular expression once per test. A test for all-digit names would
    # never fire: cleaning has removed the digits.
    pairs = pairs.select(F.inline(F.filter(F.array(cleaned), long_enough)))
    if dedup_after_clean:
        pairs = pairs.dropDuplicates(["left_name", "right_name"])
    return pairs.withColumn("label", F.lit(1))


def swapped_pairs(pairs: DataFrame, left: str = "left_name", right: str = "right_name") -> DataFrame:
    """Pairs whose mirror image is also in the table: likely data-entry errors.

    Both directions are folded onto one ordered key and counted, one aggregation instead of a
    self-join.
    """
    a, b = F.col(left), F.col(right)
    folded = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).groupBy(
        F.least(a, b).alias("first_name"), F.greatest(a, b).alias("second_name"))
    counted = folded.agg(
        F.count_if(a < b).alias("n_forward"),
        F.count_if(a > b).alias("n_reversed"),
    )
    return counted.where((F.col("n_forward") > 0) & (F.col("n_reversed") > 0))
