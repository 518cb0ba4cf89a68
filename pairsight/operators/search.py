"""Entity listings and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.functions.text import contains_ignore_case


def entities(pairs: DataFrame, name: str) -> DataFrame:
    """Distinct non-null names."""
    return pairs.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()


def search_entities(pairs: DataFrame, name: str, query: str = "", limit: int = 20) -> DataFrame:
    """First ``limit`` names in order that contain the query, ignoring case.

    The filter runs before the distinct, and sort with limit becomes a per-task top-k.
    """
    source = pairs
    if query:
        source = source.where(contains_ignore_case(F.col(name), F.lit(query)))
    return entities(source, name).orderBy("name").limit(limit)


def pair_stats(pairs: DataFrame, left: str, right: str, approximate: bool = False) -> DataFrame:
    """One row: total rows, distinct names per side (nulls not counted), loaded flag."""
    count_names = F.approx_count_distinct if approximate else F.count_distinct
    return pairs.agg(
        F.count("*").alias("total_rows"),
        count_names(F.col(left)).alias("unique_left"),
        count_names(F.col(right)).alias("unique_right"),
    ).withColumn("loaded", F.col("total_rows") > 0)


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Counts per value, most frequent first, names in order within equal counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count("*").alias("n"))
    ordered = counts.orderBy(F.desc("n"), "value")
    return ordered if limit is None else ordered.limit(limit)


def risk_distribution(df: DataFrame, risk: str = "risk_level") -> DataFrame:
    """Counts of the three risk levels, with zero for a level that does not occur."""
    return df.agg(*[F.count_if(F.col(risk) == level).alias(f"{level.lower()}_count") for level in V.RISK_LEVELS])


def risk_map(df: DataFrame, risk: str = "risk_level") -> DataFrame:
    """One row with a map from risk level to count. The levels are few by definition."""
    counts = df.groupBy(risk).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(risk, "n")))).alias("risk_distribution"))


def probability_bands(df: DataFrame, p: str) -> DataFrame:
    """Rows above 0.7, in (0.3, 0.7], and up to 0.3."""
    c = F.col(p)
    return df.agg(
        F.count_if(c > 0.7).alias("high_risk"),
        F.count_if((c > 0.3) & (c <= 0.7)).alias("medium_risk"),
        F.count_if(c <= 0.3).alias("low_risk"),
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class: count, ``balanced`` weight n / (2 n_c), and the negative to positive ratio.

    Two counts come out of one aggregation; the ratio is 1 when there are no positives.
    """
    c = F.col(label)
    totals = df.agg(F.count_if(c == 0).alias("n0"), F.count_if(c == 1).alias("n1"))
    ratio = F.when(F.col("n1") > 0, F.col("n0") / F.col("n1")).otherwise(F.lit(1.0))
    per_class = F.inline(F.array(*[
        F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("n")) for k in (0, 1)]))
    rows = totals.select((F.col("n0") + F.col("n1")).alias("total"), ratio.alias("ratio"), per_class)
    return rows.where("n > 0").select("label", "n", (F.col("total") / (2 * F.col("n"))).alias("weight"), "ratio")


def feature_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, feature count, missing values, infinite values over the given columns."""
    def total(test) -> Column:
        return sum((F.count_if(test(F.col(c))) for c in columns[1:]), F.count_if(test(F.col(columns[0]))))

    infinite = (float("inf"), float("-inf"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(columns)).cast("bigint").alias("n_features"),
        total(lambda c: c.isNull() | F.isnan(c)).alias("n_missing"),
        total(lambda c: c.isin(*infinite)).alias("n_infinite"),
    )


def feature_types(df: DataFrame) -> dict[str, int]:
    """Number of columns per type, from the schema alone."""
    counts: dict[str, int] = {}
    for _, kind in df.dtypes:
        counts[kind] = counts.get(kind, 0) + 1
    return counts
