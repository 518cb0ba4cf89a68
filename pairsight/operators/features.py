"""Feature columns of a categorised pair table, and the fitted pipeline around them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    ElementwiseProduct, OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler, VectorSizeHint)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.functions.scoring import risk_score
from pairsight.functions.text import char_jaccard
from pairsight.operators.categorize import LEFT, RIGHT, RULES, CategoryDictionary, RuleTable
from pairsight.operators.text_features import TextFeatures, fit_text_features

NUMERIC = ["risk_score", "drug_length", "food_length", "name_similarity", "same_category", "both_other"]


def pair_features(pairs: DataFrame, left: str = "left_name", right: str = "right_name") -> DataFrame:
    """Append the joined text and the numeric features of a pair with categories and rule."""
    l, r = F.col(left), F.col(right)
    lc, rc = F.col("left_category"), F.col("right_category")
    return pairs.withColumns({
        "combined_text": F.concat_ws(" ", l, r),
        "risk_score": risk_score(F.col("risk_level"), F.col("mechanism"), lc, rc),
        "drug_length": F.char_length(l),
        "food_length": F.char_length(r),
        "name_similarity": char_jaccard(l, r),
        "same_category": (lc == rc).cast("int"),
        "both_other": ((lc == V.OTHER) & (rc == V.OTHER)).cast("int"),
    })


def one_hot(df: DataFrame, column: str, labels: list[str], prefix: str) -> DataFrame:
    """0/1 columns ``prefix_label`` in value order. The labels are given, so nothing is fitted."""
    flags = {f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in sorted(labels)}
    return df.withColumns(flags)


def align_features(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Bring an external wide table to a fixed column list: missing ones become 0, others are dropped."""
    picked = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
              for c in columns]
    return df.select(*(keep or []), *picked)


def standardize(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population deviation per column, fitted on ``fit_on``; deviation 0 counts as 1.

    Statistics are one aggregation, read as a scalar subquery.
    """
    source = df if fit_on is None else fit_on
    stats = source.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])).scalar()
    with_stats = df.withColumn("_stats", stats)

    def scaled(c: str):
        s = F.col(f"_stats.s_{c}")
        return (F.col(c) - F.col(f"_stats.m_{c}")) / F.when(s > 0, s).otherwise(F.lit(1.0))

    return with_stats.withColumns({f"{c}_scaled": scaled(c) for c in columns}).drop("_stats")


@dataclass
class FeatureSpace:
    """Fitted features: the pipeline that builds ``features``, its column names and their groups."""

    model: PipelineModel
    names: list[str]
    groups: list[int]
    group_names: list[str]
    text: list[TextFeatures] = field(default_factory=list)

    def transform(self, pairs: DataFrame) -> DataFrame:
        return self.model.transform(pair_features(pairs))


def fit_feature_space(train: DataFrame, left_dict: CategoryDictionary = LEFT, right_dict: CategoryDictionary = RIGHT,
                      rules: RuleTable = RULES, text_terms: int = 50, text_components: int = 10) -> FeatureSpace:
    """Build the feature pipeline. Only the text features look at the data.

    The category vocabularies come from the dictionaries, so training and scoring always produce
    the same columns, whichever categories happen to occur.
    """
    categorical = [
        ("left_category", "drug", left_dict.labels),
        ("right_category", "food", right_dict.labels),
        ("mechanism", "mechanism", rules.mechanisms),
        ("risk_level", "risk", sorted(V.RISK_LEVELS)),
    ]
    stages, inputs, indexed = [], [], []
    names: list[str] = []
    groups: list[int] = []
    group_names: list[str] = []
    for column, prefix, labels in categorical:
        indexer = StringIndexerModel.from_labels(labels, column, f"{column}_index", handleInvalid="keep")
        encoder = OneHotEncoder(inputCols=[f"{column}_index"], outputCols=[f"{column}_hot"], dropLast=False)
        stages += [indexer, encoder]
        inputs.append(f"{column}_hot")
        indexed.append(f"{column}_index")
        group_names.append(f"{prefix}_category" if prefix in ("drug", "food") else f"{prefix}_any")
        slots = [*labels, "unseen"]
        names += [f"{prefix}_{v}" for v in slots]
        groups += [len(group_names) - 1] * len(slots)
    for column in NUMERIC:
        inputs.append(column)
        names.append(column)
        group_names.append(column)
        groups.append(len(group_names) - 1)
    fitted_text = []
    for side, prefix in (("left_name", "drug_text"), ("right_name", "food_text")):
        text = fit_text_features(train, side, prefix, text_terms, text_components)
        fitted_text.append(text)
        stages += [*text.stages, VectorSizeHint(inputCol=text.output, size=text_components)]
        inputs.append(text.output)
        group_names.append(f"{prefix}_all")
        names += [f"{prefix}_{i}" for i in range(text_components)]
        groups += [len(group_names) - 1] * text_components
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    # Categories as single indexed features, for learners that split on categories directly.
    stages.append(VectorAssembler(inputCols=[*indexed, *inputs[len(indexed):]], outputCol="features_indexed",
                                  handleInvalid="keep"))
    # Only the encoders are still to be fitted, and they read column metadata: one row is enough.
    model = Pipeline(stages=stages).fit(pair_features(train).limit(1))
    return FeatureSpace(model, names, groups, group_names, fitted_text)


def scaling_stages(train: DataFrame, column: str = "features", output: str = "scaled") -> list:
    """Standard scaling with the population deviation.

    The library scaler divides by the sample deviation; the factor sqrt(n / (n - 1)) corrects it.
    """
    n = train.count()
    factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
    scaler = StandardScaler(inputCol=column, outputCol="_scaled_sample", withMean=True, withStd=True).fit(train)
    size = len(scaler.mean)
    return [scaler, ElementwiseProduct(scalingVec=Vectors.dense([factor] * size), inputCol="_scaled_sample",
                                       outputCol=output)]
