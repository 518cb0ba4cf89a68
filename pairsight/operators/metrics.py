"""Evaluation of a scored table: label (0/1), prediction (0/1), probability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.functions.scoring import min_max
from pairsight.operators.ordering import RANGE_BUCKETS, running_totals
from pairsight.plans.shared import write_once

MIN_CALIBRATION_ROWS = 50
CLASSES = (0, 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four cells of the confusion matrix, zeros included. One aggregation to one row."""
    l, p = F.col(label), F.col(prediction)
    cells = [(a, b) for a in CLASSES for b in CLASSES]
    row = scored.agg(*[F.count_if((l == a) & (p == b)).alias(f"c{a}{b}") for a, b in cells])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("label"), F.lit(b).alias("prediction"), F.col(f"c{a}{b}").alias("n"))
        for a, b in cells])))


def counted_scores(scored: DataFrame, label: str, prediction: str | None, probability: str) -> DataFrame:
    """Rows per (score, label, prediction), stored.

    Every metric follows from these counts, so the scored rows, which may come from an expensive
    model, are read exactly once. Equal scores collapse before the shuffle.
    """
    keys = [F.col(probability).cast("double").alias("score"), F.col(label).cast("int").alias("label")]
    if prediction is not None:
        keys.append(F.col(prediction).cast("int").alias("prediction"))
    return write_once(scored.groupBy(*keys).agg(F.count("*").alias("n")), "score-counts")


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                           weight: Column | None = None) -> DataFrame:
    """Accuracy and class-weighted precision, recall and F1; a zero denominator gives 0."""
    l, p, w = F.col(label), F.col(prediction), F.lit(1) if weight is None else weight
    cells = [(a, b) for a in CLASSES for b in CLASSES]
    row = scored.agg(*[
        F.coalesce(F.sum(F.when((l == a) & (p == b), w)), F.lit(0)).alias(f"c{a}{b}") for a, b in cells])
    total = sum((F.col(f"c{a}{b}") for a, b in cells), F.lit(0))
    precision = recall = f1 = F.lit(0.0)
    for k in CLASSES:
        o = 1 - k
        hit, support, called = F.col(f"c{k}{k}"), F.col(f"c{k}{k}") + F.col(f"c{k}{o}"), F.col(f"c{k}{k}") + F.col(f"c{o}{k}")
        pk, rk = _ratio(hit, called), _ratio(hit, support)
        fk = _ratio(2 * hit, support + called)
        share = _ratio(support, total)
        precision, recall, f1 = precision + pk * share, recall + rk * share, f1 + fk * share
    return row.select(
        total.alias("n_rows"), _ratio(F.col("c00") + F.col("c11"), total).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def score_totals(counts: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: equal scores become one threshold."""
    l, n = F.col("label"), F.col("n")
    return counts.groupBy("score").agg(
        F.sum(F.when(l == 1, n).otherwise(F.lit(0))).alias("pos"),
        F.sum(F.when(l == 1, F.lit(0)).otherwise(n)).alias("neg"))


def ranking_metrics(counts: DataFrame, buckets: int = RANGE_BUCKETS) -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum); 0 when one class is missing.

    Works on the counts of ``counted_scores``.
    """
    totals = write_once(score_totals(counts), "score-totals")
    running = running_totals(totals, "score", ["pos", "neg"], buckets)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    positives, negatives = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    below = F.col("all_neg") - F.col("cum_neg")
    precision_at = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    both = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    # try_divide keeps a one-class table from failing under ANSI division.
    area = F.sum(F.try_divide(pos * (below + neg / 2), positives * negatives))
    average = F.sum(F.try_divide(pos, positives) * precision_at)
    return running.agg(
        F.when(both, area).otherwise(F.lit(0.0)).alias("roc_auc"),
        F.when(both, average).otherwise(F.lit(0.0)).alias("avg_precision"))


def evaluate(scored: DataFrame, label: str = "label", prediction: str = "prediction",
             probability: str = "p") -> DataFrame:
    """One row with all metrics of a model, from one pass over its scored rows."""
    counts = counted_scores(scored, label, prediction, probability)
    both = classification_metrics(counts, weight=F.col("n"))
    ranking = ranking_metrics(counts)
    one = ranking.select(F.struct("roc_auc", "avg_precision")).scalar()
    return both.withColumn("_ranking", one).select(*both.columns, "_ranking.*")


def roc_points(scored: DataFrame, label: str = "label", probability: str = "p", drop_intermediate: bool = True,
               buckets: int = RANGE_BUCKETS) -> DataFrame:
    """ROC curve: one row per threshold from high to low, after the origin (threshold infinity).

    ``drop_intermediate`` leaves out points on a straight line between their neighbours: those
    whose step equals the next step in both directions.
    """
    totals = write_once(score_totals(counted_scores(scored, label, None, probability)), "score-totals")
    running = running_totals(totals, "score", ["pos", "neg"], buckets)
    if drop_intermediate:
        running = _mark_corners(running).where("_corner")
    fpr = _ratio(F.col("cum_neg"), F.col("all_neg"))
    tpr = _ratio(F.col("cum_pos"), F.col("all_pos"))
    points = running.select(F.col("score").alias("threshold"), F.col("cum_neg").alias("fp"),
                            F.col("cum_pos").alias("tp"), fpr.alias("fpr"), tpr.alias("tpr"))
    origin = scored.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("fp"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _mark_corners(running: DataFrame) -> DataFrame:
    """Compare each step with the next lower score's, across bucket edges too."""
    step = F.struct("pos", "neg")
    heads = running.groupBy("_bucket").agg(F.max_by(step, "score").alias("_head"), F.max("score").alias("_top"))
    across = W.orderBy(F.desc("_bucket"))  # one row per bucket
    edges = heads.select("_bucket", F.lead("_head").over(across).alias("_next_head"),
                         F.lag(F.lit(1)).over(across).isNull().alias("_first_bucket"), "_top")
    inside = W.partitionBy("_bucket").orderBy(F.desc("score"))
    nxt = F.coalesce(F.lead(step).over(inside), F.col("_next_head"))
    joined = running.join(F.broadcast(edges), "_bucket")
    first = F.col("_first_bucket") & (F.col("score") == F.col("_top"))
    return joined.withColumn("_next", nxt).withColumn(
        "_corner",
        first | F.col("_next").isNull() | (F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg")))


def bin_edges(n_bins: int = 10) -> list[float]:
    """Equally spaced edges by repeated multiplication, e.g. 3 x 0.1 = 0.30000000000000004."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def calibration_bins(scored: DataFrame, label: str = "label", probability: str = "p", n_bins: int = 10) -> DataFrame:
    """Per non-empty bin (lo, hi]: share of positives, mean probability, rows. 0 lies in no bin."""
    edges = bin_edges(n_bins)
    p = F.col(probability)
    bins = [F.when((p > lo) & (p <= hi), F.lit(i)) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    binned = scored.select(F.coalesce(*bins).alias("bin"), F.col(label).cast("double").alias("_l"), p.alias("_p"))
    rows = binned.where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.avg("_l").alias("accuracy"), F.avg("_p").alias("confidence"), F.count("*").alias("n"))
    lowers, uppers = (F.array(*[F.lit(e) for e in part]) for part in (edges[:-1], edges[1:]))
    return rows.select("bin", F.get(lowers, "bin").alias("bin_lower"), F.get(uppers, "bin").alias("bin_upper"),
                       "accuracy", "confidence", "n")


def calibration_error(scored: DataFrame, label: str = "label", probability: str = "p", n_bins: int = 10) -> DataFrame:
    """Unweighted mean of |accuracy - confidence| over the bins; an error text below 50 rows."""
    bins = calibration_bins(scored, label, probability, n_bins)
    size = scored.agg(F.count("*")).scalar()
    joined = bins.agg(
        F.avg(F.abs(F.col("accuracy") - F.col("confidence"))).alias("_ece"),
        F.count("*").alias("n_bins")).withColumn("n_rows", size)
    enough = F.col("n_rows") >= MIN_CALIBRATION_ROWS
    return joined.select(
        "n_rows", "n_bins",
        F.when(enough, F.col("_ece")).alias("expected_calibration_error"),
        F.when(~enough, F.lit("Insufficient data for calibration analysis")).alias("error"))


def uncertainty_summary(predictions: DataFrame, by: list[str], prediction: str = "prediction",
                        probability: str = "p") -> DataFrame:
    """Summary of replicate predictions per row: mean, spread, 95% interval, stability, level."""
    spread = F.col("std_probability")
    return predictions.groupBy(*by).agg(
        F.count("*").alias("n_replicates"),
        F.avg(probability).alias("mean_probability"),
        F.stddev_pop(probability).alias("std_probability"),
        F.percentile(probability, F.array(F.lit(0.025), F.lit(0.975))).alias("_ci"),
        F.avg(F.col(prediction).cast("double")).alias("prediction_stability"),
    ).select(
        *by, "n_replicates", "mean_probability", "std_probability",
        F.col("_ci")[0].alias("ci_lower"), F.col("_ci")[1].alias("ci_upper"), "prediction_stability",
        F.when(spread > 0.2, "HIGH").when(spread > 0.1, "MEDIUM").otherwise("LOW").alias("uncertainty_level"))


def minmax_score(df: DataFrame, value: str, output: str = "score") -> DataFrame:
    """Rescale a decision score to [0, 1] by the table's minimum and maximum."""
    span = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high"))).scalar()
    return df.withColumn("_span", span).withColumn(
        output, min_max(F.col(value), F.col("_span.low"), F.col("_span.high"))).drop("_span")


def soft_vote(df: DataFrame, probabilities: list[str], threshold: float = 0.5) -> DataFrame:
    """Mean of at least two models' probabilities, with the label at the threshold."""
    if len(probabilities) < 2:
        raise ValueError("soft voting needs at least two models")
    mean = reduce(lambda a, b: a + b, [F.col(c) for c in probabilities]) / F.lit(float(len(probabilities)))
    return df.withColumn("p_vote", mean).withColumn("vote", (F.col("p_vote") > threshold).cast("int"))


def leaderboard(metrics: DataFrame, top: int | None = None) -> DataFrame:
    """Models by F1, best first, names in order within equal scores."""
    ranked = metrics.orderBy(F.desc("f1"), "model")
    return ranked if top is None else ranked.limit(top)
