"""The library's inputs, built from the given star-schema tables.

Pair table: line items with their part name (left) and the customer's market segment (right).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.functions.hashing import stable_key
from pairsight.operators.categorize import CategoryDictionary, RuleTable, category_of, with_rule

LEFT = CategoryDictionary.of([
    ("thermal", ["hot", "cold"]),
    ("age", ["old", "new"]),
    ("fastener", ["bolt", "ring", "rod"]),
    ("drive", ["gear"]),
    ("heavy", ["anvil", "plate"]),
    ("colour", ["red", "blue"]),
])
RIGHT = CategoryDictionary.of([
    ("home", ["house", "furnit"]),
    ("industry", ["machin", "build"]),
])
# Mechanism names with advice texts, so that the lookups have something to find.
RULES = RuleTable.of([
    ("thermal", "industry", "cyp3a4_inhibition", "HIGH"),
    ("heavy", "home", "vitamin_k_competition", "HIGH"),
    ("age", "industry", "calcium_chelation", "MODERATE"),
    ("fastener", "home", "absorption_interference", "MODERATE"),
    ("drive", "industry", "acid_suppression_interference", "LOW"),
])
ALTERNATIVES = {
    "hot plate": (["MACHINERY", "BUILDING"], ["HOUSEHOLD"]),
    "cold gear": ([], ["FURNITURE", "HOUSEHOLD"]),
}
EVENT_LEFT = CategoryDictionary.of([
    ("browse", ["view", "click"]),
    ("convert", ["purchase", "sign"]),
])
EVENT_RIGHT = CategoryDictionary.of([
    ("odd", ["1", "3", "5", "7", "9"]),
    ("even", ["0", "2", "4", "6", "8"]),
])
EVENT_RULES = RuleTable.of([
    ("convert", "odd", "fluid_retention", "HIGH"),
    ("browse", "even", "bp_elevation", "MODERATE"),
])
STOP_WORDS = ["the", "and", "of", "to", "in", "is", "it", "that", "le", "la", "les", "un", "une", "et", "de", "der",
              "die", "das", "und", "el", "los", "las", "en", "on", "or", "as", "at", "by", "for", "are"]


# Schemas of the given tables. Stating them saves a footer-reading job per scan.
SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_key() -> Column:
    """Unique row key of a line item; prices as whole cents so that the text form is exact."""
    return stable_key(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))


def pair_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with both names, their categories and the rule.

    Names live in the dimension tables, so categories are worked out there, once per part and
    customer, and travel through the joins.
    """
    parts = load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("left_name"),
        category_of(F.col("p_name"), LEFT).alias("left_category"))
    customers = load(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("right_name"),
        category_of(F.col("c_mktsegment"), RIGHT).alias("right_category"))
    buyers = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(
        customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").join(
        buyers, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    pairs = joined.withColumns({
        "row_id": line_key(),
        "left_key": F.col("l_partkey"),
        "right_key": F.col("o_custkey"),
        "label": (F.col("l_returnflag") == "R").cast("int"),
        "p": F.col("l_discount") * 10,
        "prediction": (F.col("l_discount") * 10 > 0.5).cast("int"),
    })
    return with_rule(pairs, RULES)


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label, score and prediction of each line item: one scan, no join."""
    return load(spark, sf_dir, "lineitem").select(
        line_key().alias("row_id"), F.col("l_partkey").alias("left_key"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 10).alias("p"), (F.col("l_discount") * 10 > 0.5).cast("int").alias("prediction"))


def left_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the part's name and category."""
    parts = load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("left_name"), category_of(F.col("p_name"), LEFT).alias("left_category"))
    lines = load(spark, sf_dir, "lineitem")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        line_key().alias("row_id"), "left_name", "left_category")


def right_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the order's status, and the buyer's segment and category."""
    customers = load(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("right_name"), category_of(F.col("c_mktsegment"), RIGHT).alias("right_category"))
    buyers = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(
        customers, F.col("o_custkey") == F.col("c_custkey"))
    return load(spark, sf_dir, "lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        line_key().alias("row_id"), "right_name", "right_category", "o_orderstatus", "l_linestatus")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second scored table: document quality against a length score with many distinct values."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.least(F.col("n_chars") / F.lit(5000.0), F.lit(1.0)).alias("p"))
    labels = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.join(docs, "doc_id").withColumn("prediction", (F.col("p") > 0.5).cast("int"))


FEATURE_STEMS = ["drug_text_", "food_text_", "mechanism_m", "risk_r", "name_similarity_", "same_category_"]


def attribution_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attribution table from the embedding vectors: dimension -> feature name."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("i", "x"))
    stems = F.array(*[F.lit(s) for s in FEATURE_STEMS])
    x = F.col("x").cast("double")
    small = F.abs(x) < 0.01
    return vectors.select(
        "row_id", F.concat(F.get(stems, F.col("i") % len(FEATURE_STEMS)), F.col("i").cast("string")).alias("feature"),
        F.abs(x).alias("value"), F.when(small, F.lit(0.0)).otherwise(x).alias("attribution"))


def attribution_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("prediction"))


def requests(events: DataFrame) -> DataFrame:
    """JSON request bodies from the event table: padded names, missing, empty and malformed ones."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    full = F.concat(F.lit('{"drug": "  '), kind, F.lit('\\t ", "food": "'), k, F.lit('"}'))
    no_right = F.concat(F.lit('{"drug": "'), kind, F.lit('"}'))
    blank_right = F.concat(F.lit('{"drug": "'), kind, F.lit('", "food": "   "}'))
    broken = F.concat(F.lit('{"drug": "'), kind)
    body = F.when(F.col("value") < 2, no_right).when(F.col("value") < 4, blank_right).when(
        F.col("value") < 6, broken).otherwise(full)
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), body.alias("body"))


def dirty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature columns with nulls, NaN and infinities."""
    lines = load(spark, sf_dir, "lineitem")
    return lines.select(
        line_key().alias("row_id"),
        F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_discount") > 0.09, F.lit(float("-inf")))
        .otherwise(F.col("l_discount")).alias("f1"),
        F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_tax") > 0.07, F.lit(None))
        .otherwise(F.col("l_tax")).alias("f2"))
