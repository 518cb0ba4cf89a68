"""Named queries: each runs one operator of the library over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.functions import scoring as S
from pairsight.functions.text import char_jaccard, clean_text, title_case, words_display
from pairsight.operators import attributions as A
from pairsight.operators import basket, batch, categorize, clean, counterfactual, explain, features, lookups
from pairsight.operators import metrics as M
from pairsight.operators import models, override, sampling, search, service, similar
from pairsight.operators.dashboard import dashboard
from pairsight.operators.forest import Forest
from pairsight.operators.ordering import dense_position
from pairsight.operators.text_features import fit_svd, fit_tfidf, tfidf_table
from pairsight.plans import demo_tables as D
from pairsight.plans.shared import new_path, write_once
from pairsight.plans.sizing import spread
from pairsight.sources import package, requests, synthetic, tables
from pairsight.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RULE = ["left_category", "right_category", "mechanism", "risk_level"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__.removesuffix("_query")] = fn
    return fn


def _r6(*columns: str) -> dict:
    """Sums of doubles depend on the order of addition; six digits do not."""
    return {c: F.round(c, 6) for c in columns}


# --- Sources and sinks -----------------------------------------------------------------------

@query
def src_pairs_csv(spark, sf):
    path = new_path(spark, "pairs-csv")
    D.pair_table(spark, sf).select(F.col("left_name").alias("drug"), F.col("right_name").alias("food")).write.option(
        "header", True).csv(path)
    return tables.read_pairs_csv(spark, path, ["drug", "food"])


@query
def src_labelled(spark, sf):
    path = new_path(spark, "labelled")
    D.pair_table(spark, sf).select(
        F.col("left_name").alias("drug"), F.col("right_name").alias("food"), F.col("label").alias("interaction"),
        F.col("left_category").alias("drug_category"), F.col("right_category").alias("food_category"),
        "mechanism", "risk_level").write.parquet(path)
    return tables.read_labelled(spark, path)


@query
def src_curated_json(spark, sf):
    path = new_path(spark, "curated")
    D.pair_table(spark, sf).select(
        F.col("left_name").alias("drug"), F.col("right_name").alias("food"), "risk_level", "mechanism",
        lookups.explanation(F.col("mechanism")).alias("explanation"),
        lookups.recommendation(F.col("risk_level")).alias("recommendations")).write.json(path)
    return tables.distinct_curated(tables.read_curated_json(spark, path, multi_line=False))


@query
def src_synthetic_pairs(spark, sf):
    ids = D.load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return synthetic.pairs_for_ids(ids, synthetic.V.SYNTHETIC_LEFT, synthetic.V.SYNTHETIC_RIGHT)


@query
def sink_model_package(spark, sf):
    trained = _forest(spark, sf)
    path = new_path(spark, "package")
    package.save_package(trained, path, left_dict=D.LEFT, right_dict=D.RIGHT, rules=D.RULES)
    loaded = package.load_package(spark, path)
    pairs = _new_pairs(spark, sf)
    after = models.score_pairs(pairs, loaded, "left", "right", left_dict=loaded.left_dict,
                               right_dict=loaded.right_dict, rules=loaded.rules)
    before = models.score_pairs(pairs, trained, "left", "right", left_dict=D.LEFT, right_dict=D.RIGHT, rules=D.RULES)
    before = before.select("left", "right", F.col("probability").alias("_before"))
    same = F.coalesce(F.abs(F.col("probability") - F.col("_before")) < 1e-9, F.lit(False))
    return after.join(before, ["left", "right"], "left").select("left", "right", *RULE, same.alias("same_score"))


@query
def req_decode_validate(spark, sf):
    decoded = requests.decode_requests(D.requests(D.load(spark, sf, "events")), "body")
    errors = requests.rejected(decoded).select("event_id", "left_name", "right_name", "error")
    good = requests.accepted(decoded).select("event_id", "left_name", "right_name", F.lit(None).cast("string").alias("error"))
    return good.unionByName(errors)


@query
def result_envelope(spark, sf):
    pairs = D.pair_table(spark, sf)
    record = F.struct(F.col("left_name").alias("drug"), F.col("right_name").alias("food"),
                      S.percent(F.col("p")).alias("percent"), F.col("risk_level"))
    wrapped = pairs.select(
        "row_id", F.when(F.col("label") == 1, requests.success_envelope(record)).otherwise(
            requests.error_envelope(F.concat(F.lit("no result for "), F.col("left_name")))).alias("envelope"))
    return wrapped.withColumn("payload", requests.unwrap(F.col("envelope")))


# --- Cleaning, categories, rules -------------------------------------------------------------

@query
def clean_pairs(spark, sf):
    return clean.clean_pairs(_documents(spark, sf), "text", "source")


@query
def clean_pairs_distinct(spark, sf):
    turns = D.load(spark, sf, "conversations")
    return clean.clean_pairs(turns, "text", "role", dedup_after_clean=True)


@query
def clean_text_query(spark, sf):
    return D.load(spark, sf, "conversations").select("conv_id", "turn", clean_text(F.col("text")).alias("cleaned"))


@query
def swapped_pairs(spark, sf):
    pairs = D.right_lines(spark, sf).select(
        F.col("o_orderstatus").alias("left_name"), F.col("l_linestatus").alias("right_name"))
    return clean.swapped_pairs(pairs)


@query
def categorize_left(spark, sf):
    return D.left_lines(spark, sf).select("row_id", "left_name", "left_category")


@query
def categorize_right(spark, sf):
    return D.right_lines(spark, sf).select("row_id", "right_name", "right_category")


# Topics of the large dictionary: each distinct word of the documents table falls into one by its MD5 integer.
LARGE_TOPICS = 40


def large_dictionary(spark, sf) -> DataFrame:
    """(ord, category, term): the fixed left categories, then every distinct word of 4 to 12 letters A-Z of the
    documents as a term of one of LARGE_TOPICS topics. Tens of thousands of terms at sf0.01, more with the corpus."""
    from pairsight.functions.hashing import u60

    letters = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = (D.load(spark, sf, "documents").select(F.explode(F.regexp_extract_all(letters, F.lit("([a-z]+)"), 1)).alias("term"))
             .where(F.length("term").between(4, 12)).distinct())
    topic = u60(F.col("term")) % LARGE_TOPICS
    derived = words.select((F.lit(len(D.LEFT.entries)) + topic).cast("int").alias("ord"),
                           F.concat(F.lit("topic_"), topic.cast("string")).alias("category"), "term")
    return D.LEFT.to_table(spark).unionByName(derived)


@query
def categorize_large(spark, sf):
    parts = D.load(spark, sf, "part").select("p_partkey", "p_name")
    found = categorize.category_by_index(parts, "p_name", large_dictionary(spark, sf))
    return parts.join(found, parts["p_name"].eqNullSafe(found["name"]), "left").select(
        "p_partkey", "p_name", F.coalesce("category", F.lit("other")).alias("category"))


@query
def rule_join(spark, sf):
    return D.pair_table(spark, sf).select("row_id", *RULE)


@query
def rule_join_table(spark, sf):
    pairs = D.pair_table(spark, sf).select("row_id", "left_category", "right_category")
    return categorize.with_rule_table(pairs, D.RULES.to_table(spark)).select("row_id", *RULE)


@query
def risk_score(spark, sf):
    return D.pair_table(spark, sf).select("row_id", S.risk_score(
        F.col("risk_level"), F.col("mechanism"), F.col("left_category"), F.col("right_category")).alias("risk_score"))


# --- Lookups and listings --------------------------------------------------------------------

@query
def search_entities(spark, sf):
    left = search.search_entities(D.load(spark, sf, "part"), "p_name", "OLD").select(F.lit("left").alias("side"), "name")
    right = search.search_entities(D.load(spark, sf, "customer"), "c_name", "99").select(F.lit("right").alias("side"), "name")
    return left.unionByName(right)


@query
def known_override(spark, sf):
    pairs = D.pair_table(spark, sf)
    known = pairs.where(F.col("risk_level") == "HIGH").select("row_id", "left_name", "right_name", *override.DETAILS)
    targets = pairs.select("row_id", F.upper("left_name").alias("left_name"), "right_name", *RULE,
                           (F.col("p") > 0.5).alias("interaction_predicted"), F.col("p").alias("probability"))
    return override.known_override(targets, known, "left_name", "right_name", "row_id", "row_id", "probability").select(
        "row_id", "interaction_predicted", "probability", "source", *RULE)


def _known_and_targets(spark, sf):
    known = D.pair_table(spark, sf)
    return known, known.select("left_name", "right_name", *RULE).distinct()


@query
def similar_strict(spark, sf):
    known, targets = _known_and_targets(spark, sf)
    return similar.similar_strict(targets, known, "row_id", ["left_name", "right_name", "label", "risk_level"]).select(
        "left_name", "right_name", "rank", "similar_left_name", "similar_right_name", "similar_label", "similar_risk_level")


@query
def similar_loose(spark, sf):
    known, targets = _known_and_targets(spark, sf)
    return similar.similar_loose(targets, known, "row_id", ["left_name", "right_name", "risk_level"], "label").select(
        "left_name", "right_name", "rank", "similar_left_name", "similar_right_name", "similar_risk_level")


@query
def explained_pairs(spark, sf):
    known, targets = _known_and_targets(spark, sf)
    scored = targets.withColumn("probability", _rule_probability())
    nested = similar.similar_lists(scored, known, "row_id", ["left_name", "right_name", "label", "risk_level"])
    details = lookups.mechanism_details(F.col("mechanism"))
    item = F.transform("similar", lambda s: F.concat_ws(
        "/", s["left_name"], s["right_name"], s["label"].cast("string"), s["risk_level"]))
    return nested.select(
        "left_name", "right_name", "probability", details["description"].alias("description"),
        details["clinical_impact"].alias("clinical_impact"), details["timing"].alias("timing"),
        F.array_join(item, ";").alias("similar"), S.confidence_band(F.col("probability")).alias("confidence_level"),
        S.significance(F.col("risk_level")).alias("clinical_significance"))


def _rule_probability():
    """Deterministic stand-in for a model: the risk score over its maximum."""
    score = S.risk_score(F.col("risk_level"), F.col("mechanism"), F.col("left_category"), F.col("right_category"))
    return score / F.lit(5.0)


@query
def batch_cross_score(spark, sf):
    return _batch(spark, sf, 100)


@query
def batch_cross_all(spark, sf):
    return _batch(spark, sf, None)


@query
def batch_summary(spark, sf):
    """Over all combinations, from counts per category."""
    def listed(table, column, dictionary):
        names = search.entities(D.load(spark, sf, table), column)
        return names.select("name", categorize.category_of(F.col("name"), dictionary).alias("category"))

    def score(pairs):
        return categorize.with_rule(pairs, D.RULES).withColumn("interaction_predicted", _rule_probability() > 0.5)

    return batch.summary_by_category(listed("part", "p_name", D.LEFT), listed("customer", "c_mktsegment", D.RIGHT), score)


def _batch(spark, sf, cap):
    def listed(table, column):
        return dense_position(search.entities(D.load(spark, sf, table), column), "name", "position")

    combos = batch.combinations(listed("part", "p_name"), listed("customer", "c_mktsegment"), cap)
    ready = categorize.enrich(combos, "left_name", "right_name", D.LEFT, D.RIGHT, D.RULES)
    scored = ready.withColumn("probability", _rule_probability())
    return scored.select("combo_id", "left_name", "right_name", (F.col("probability") > 0.5).alias("interaction_predicted"),
                         "probability", "risk_level")


def _baskets(spark, sf):
    pairs = D.pair_table(spark, sf)
    lefts = pairs.select(F.col("l_suppkey").alias("basket_id"), "left_name", "left_category").distinct()
    rights = pairs.select(F.col("l_suppkey").alias("basket_id"), "right_name", "right_category").distinct()
    scores = pairs.select(*RULE).distinct().withColumn("probability", _rule_probability()).withColumn(
        "interaction_predicted", F.col("probability") > 0.3)
    return lefts, rights, basket.alert_pairs(scores)


@query
def basket_compat(spark, sf):
    lefts, rights, alerts = _baskets(spark, sf)
    return basket.basket_compat(lefts, rights, alerts, "basket_id", "left_category", "right_category")


@query
def basket_alerts(spark, sf):
    lefts, rights, alerts = _baskets(spark, sf)
    return basket.basket_alerts(lefts, rights, alerts, "basket_id", "left_category", "right_category").select(
        "basket_id", "left_name", "right_name", "mechanism", "risk_level", "probability")


@query
def counterfactual_rules(spark, sf):
    pairs = D.pair_table(spark, sf).select("row_id", "left_category", "right_category")
    return counterfactual.counterfactual_rules(pairs, D.LEFT, D.RIGHT, D.RULES).select("row_id", *counterfactual.FIELDS)


@query
def counterfactual_summary(spark, sf):
    counts = D.pair_table(spark, sf).groupBy("left_category", "right_category").agg(F.count("*").alias("n_pairs"))
    summary = counterfactual.counterfactual_summary(counts, D.LEFT, D.RIGHT, D.RULES)

    def text(c):
        return F.array_join(F.transform(c, lambda s: s["scenario"]), ";").alias(c)

    return summary.select("left_category", "right_category", "n_pairs", text("safer_alternatives"),
                          text("riskier_alternatives"), text("similar_risk"))


@query
def advice_enrich(spark, sf):
    groups = D.pair_table(spark, sf).withColumn("interaction_predicted", F.col("p") > 0.5).groupBy(
        *RULE, "interaction_predicted").agg(F.count("*").alias("n_pairs"))
    return lookups.advice_enrich(groups)


@query
def mechanism_details(spark, sf):
    pairs = D.pair_table(spark, sf).groupBy("left_category", "right_category", "mechanism").agg(F.count("*").alias("n_pairs"))
    details = lookups.mechanism_details(F.col("mechanism"))
    return pairs.select("*", *[details[f].alias(f) for f in ("description", "clinical_impact", "timing")])


@query
def monitoring_advice(spark, sf):
    return D.pair_table(spark, sf).select(
        "row_id", lookups.monitoring_advice(F.col("risk_level"), F.col("mechanism")).alias("monitoring_advice"))


@query
def alternatives(spark, sf):
    parts = D.load(spark, sf, "part")
    found = lookups.alternatives(F.col("p_name"), D.ALTERNATIVES)
    return parts.select("p_partkey", F.array_join(found["foods_to_avoid"], ",").alias("avoid"),
                        F.array_join(found["safer_options"], ",").alias("safer"), found["message"].alias("message"))


@query
def decision_pathway(spark, sf):
    pairs = D.pair_table(spark, sf)
    return lookups.decision_pathway(pairs, "left_name", "right_name", "p").select(
        "row_id", "left_title", "right_title", F.col("prediction").alias("decision"), "confidence", *RULE)


@query
def decision_support(spark, sf):
    _, targets = _known_and_targets(spark, sf)
    scored = targets.withColumn("probability", _rule_probability())
    support = lookups.decision_support(scored, "left_name", "right_name", "probability", D.ALTERNATIVES)
    s, alt = F.col("patient_summary"), F.col("alternative_suggestions")
    return support.select(
        s["left"].alias("left_title"), s["right"].alias("right_title"), s["risk_level"].alias("risk_level"),
        s["simple_explanation"].alias("simple_explanation"), s["recommendation"]["message"].alias("message"),
        s["recommendation"]["action"].alias("action"), s["recommendation"]["timeline"].alias("timeline"),
        F.col("professional_details.mechanism").alias("mechanism"),
        F.col("professional_details.confidence").alias("confidence"), "monitoring_advice",
        F.array_join(alt["safer_options"], ",").alias("safer"), alt["message"].alias("alternatives_message"))


@query
def case_studies(spark, sf):
    """Named pairs of the table, each with its mean score and the decision that follows from it."""
    pairs = D.pair_table(spark, sf).groupBy("left_name", "right_name", *RULE).agg(
        F.count("*").alias("n_pairs"), F.round(F.avg("p"), 6).alias("p"))
    named = pairs.withColumn("case_name", F.concat(title_case(F.col("left_name")), F.lit("-"),
                                                   title_case(F.col("right_name")), F.lit(" Interaction")))
    return named.select("case_name", "n_pairs", S.decision_label(F.col("p"), 0.5).alias("decision"),
                        "p", *RULE)


# --- Aggregates ------------------------------------------------------------------------------

@query
def pair_stats(spark, sf):
    return search.pair_stats(D.pair_table(spark, sf), "left_name", "right_name")


@query
def category_counts(spark, sf):
    pairs = D.pair_table(spark, sf)
    left = search.value_counts(pairs, "left_category", 10).select(F.lit("left").alias("side"), "value", "n")
    right = search.value_counts(pairs, "right_category", 10).select(F.lit("right").alias("side"), "value", "n")
    return left.unionByName(right)


@query
def risk_distribution(spark, sf):
    return search.risk_distribution(D.pair_table(spark, sf))


@query
def risk_map(spark, sf):
    counts = search.risk_map(D.pair_table(spark, sf))
    return counts.select(F.to_json("risk_distribution").alias("risk_distribution"))


@query
def class_weights(spark, sf):
    return search.class_weights(D.scored_lines(spark, sf), "label")


@query
def probability_bands(spark, sf):
    return search.probability_bands(D.scored_lines(spark, sf), "p")


@query
def feature_audit(spark, sf):
    return search.feature_audit(D.dirty_features(spark, sf), ["f1", "f2"])


@query
def scrub_features(spark, sf):
    return D.dirty_features(spark, sf).select("row_id", *[S.scrub(F.col(c)).alias(c) for c in ("f1", "f2")])


@query
def feature_correlations(spark, sf):
    base = D.pair_table(spark, sf)
    pairs = features.one_hot(features.one_hot(base, "left_category", D.LEFT.labels, "drug"),
                             "risk_level", ["HIGH", "MODERATE", "LOW"], "risk")
    pairs = features.one_hot(pairs, "mechanism", D.RULES.mechanisms, "mechanism")
    columns = [f"drug_{c}" for c in D.LEFT.labels] + [f"mechanism_{m}" for m in D.RULES.mechanisms] + [
        f"risk_{r}" for r in sorted(["HIGH", "MODERATE", "LOW"])]
    return A.feature_correlations(pairs, columns).withColumns(_r6("correlation"))


@query
def calibration_bins(spark, sf):
    return M.calibration_bins(D.scored_lines(spark, sf)).withColumns(_r6("accuracy", "confidence"))


@query
def calibration_error(spark, sf):
    return M.calibration_error(D.scored_lines(spark, sf)).withColumns(_r6("expected_calibration_error"))


@query
def uncertainty_summary(spark, sf):
    lines = D.scored_lines(spark, sf).select("left_key", "p", "prediction")
    return M.uncertainty_summary(lines, ["left_key"]).withColumns(
        _r6("mean_probability", "std_probability", "ci_lower", "ci_upper", "prediction_stability"))


METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision"]


@query
def metrics(spark, sf):
    return M.evaluate(D.scored_lines(spark, sf)).withColumns(_r6(*METRICS))


@query
def metrics_documents(spark, sf):
    return M.evaluate(D.scored_documents(spark, sf)).withColumns(_r6(*METRICS))


@query
def confusion(spark, sf):
    return M.confusion(D.scored_lines(spark, sf))


@query
def roc_points(spark, sf):
    return M.roc_points(D.scored_documents(spark, sf)).withColumns(_r6("threshold", "fpr", "tpr"))


@query
def roc_points_all(spark, sf):
    return M.roc_points(D.scored_lines(spark, sf), drop_intermediate=False).withColumns(_r6("threshold", "fpr", "tpr"))


@query
def minmax_score(spark, sf):
    parts = D.load(spark, sf, "part").select("p_partkey", "p_retailprice")
    return M.minmax_score(parts, "p_retailprice").select("p_partkey", *_as(_r6("score")))


@query
def soft_vote(spark, sf):
    lines = D.load(spark, sf, "lineitem").select(
        D.line_key().alias("row_id"), (F.col("l_discount") * 10).alias("p1"), (F.col("l_tax") * 12.5).alias("p2"),
        (F.col("l_quantity") / 50).alias("p3"))
    return M.soft_vote(lines, ["p1", "p2", "p3"]).select("row_id", *_as(_r6("p_vote")), "vote")


def _as(columns: dict) -> list:
    return [c.alias(n) for n, c in columns.items()]


# --- Sampling --------------------------------------------------------------------------------

def _negatives(spark, sf):
    return sampling.sample_negatives(D.pair_table(spark, sf), "left_key", "right_key", "left_name", "right_name",
                                     D.LEFT, D.RIGHT, D.RULES)


@query
def negatives(spark, sf):
    return _negatives(spark, sf).select("draw_id", "left_key", "right_key", "left_name", "right_name", *RULE, "label")


def _labelled(spark, sf):
    columns = ["left_name", "right_name", *RULE]
    positives = D.pair_table(spark, sf).select(F.col("row_id"), *columns, F.lit(1).alias("label"))
    drawn = _negatives(spark, sf).select(F.concat(F.lit("draw-"), F.col("draw_id").cast("string")).alias("row_id"),
                                         *columns, "label")
    return sampling.labelled_union(positives, drawn)


@query
def labelled_union(spark, sf):
    return _labelled(spark, sf).groupBy("label", *RULE).agg(F.count("*").alias("n"))


@query
def stratified_split(spark, sf):
    return sampling.stratified_split(D.scored_lines(spark, sf).select("row_id", "label"), "label", "row_id")


@query
def hash_sample(spark, sf):
    return sampling.hash_sample(D.pair_table(spark, sf).select("row_id", "left_name", "right_name"), "row_id", 100)


# --- Features --------------------------------------------------------------------------------

@query
def name_jaccard(spark, sf):
    return D.load(spark, sf, "customer").select(
        "c_custkey", F.round(char_jaccard(F.col("c_name"), F.col("c_mktsegment")), 6).alias("name_similarity"))


@query
def pair_features(spark, sf):
    return features.pair_features(D.pair_table(spark, sf)).select(
        "row_id", "combined_text", *features.NUMERIC).withColumns(_r6("name_similarity"))


@query
def title_case_query(spark, sf):
    return D.load(spark, sf, "pages").select("page_id", title_case(F.col("url")).alias("title"))


@query
def confidence_band(spark, sf):
    return D.pair_table(spark, sf).select(
        "row_id", S.confidence_band(F.col("p")).alias("confidence_level"),
        S.significance(F.col("risk_level")).alias("clinical_significance"))


@query
def display_row(spark, sf):
    return D.pair_table(spark, sf).select(
        "row_id", S.percent(F.col("p")).alias("percent"), words_display(F.col("mechanism")).alias("mechanism_text"),
        F.lower("risk_level").alias("risk_class"))


@query
def personal_adjust(spark, sf):
    people = D.load(spark, sf, "customer").select(
        "c_custkey", (F.col("c_nationkey") * 4).cast("int").alias("age"),
        F.when(F.col("c_acctbal") > 0, F.filter(F.array(
            F.when(F.col("c_acctbal") > 5000, F.lit("liver_disease")),
            F.when(F.col("c_acctbal") < 7500, F.lit("kidney_disease"))), lambda c: c.isNotNull())).alias("conditions"),
        (F.abs("c_acctbal") / F.lit(10000.0)).alias("probability"))
    return models.personalise(people, "age", "conditions").select(
        "c_custkey", F.round("adjusted_probability", 8).alias("adjusted_probability"), "personalized_warning")


@query
def feature_labels(spark, sf):
    table = D.attribution_table(spark, sf)
    return table.groupBy("feature").agg(F.count("*").alias("n")).select(
        "feature", S.feature_label(F.col("feature")).alias("label_text"), "n")


@query
def one_hot(spark, sf):
    pairs = D.pair_table(spark, sf).select("row_id", "left_category", "risk_level")
    wide = features.one_hot(pairs, "left_category", D.LEFT.labels, "drug")
    wide = features.one_hot(wide, "risk_level", ["HIGH", "MODERATE", "LOW"], "risk")
    return wide.drop("left_category", "risk_level")


@query
def align_features(spark, sf):
    wide = features.one_hot(D.left_lines(spark, sf).select("row_id", "left_category"), "left_category",
                            ["thermal", "age", "gone"], "drug")
    return features.align_features(wide, ["drug_age", "drug_heavy", "drug_thermal"], keep=["row_id"])


@query
def standardize(spark, sf):
    lines = D.load(spark, sf, "lineitem").select(D.line_key().alias("row_id"), "l_quantity", "l_extendedprice")
    return features.standardize(lines, ["l_quantity", "l_extendedprice"]).select(
        "row_id", *_as(_r6("l_quantity_scaled", "l_extendedprice_scaled")))


def _documents(spark, sf):
    return spread(D.load(spark, sf, "documents").select("doc_id", "text", "source"))


@query
def tfidf_terms(spark, sf):
    fitted = fit_tfidf(_documents(spark, sf), "text", "doc", stop_words=D.STOP_WORDS)
    rows = list(zip(fitted.vocabulary, fitted.document_frequency, fitted.idf))
    return spark.createDataFrame(rows, "term string, df bigint, idf double").withColumns(_r6("idf"))


@query
def tfidf_weights(spark, sf):
    docs = _documents(spark, sf)
    fitted = fit_tfidf(docs, "text", "doc", stop_words=D.STOP_WORDS)
    return tfidf_table(docs, fitted, "doc_id").withColumns(_r6("weight"))


@query
def svd_text(spark, sf):
    docs = _documents(spark, sf)
    fitted = fit_tfidf(docs, "text", "doc", stop_words=D.STOP_WORDS)
    # The fit and the projection read the vectors from here, so the texts are split into terms once for both.
    vectors = write_once(fitted.transform(docs).select("doc_id", fitted.output), "doc-vectors")
    components, values = fit_svd(vectors, fitted.output)
    from pairsight.operators.text_features import SvdProjection

    projected = SvdProjection(fitted.output, "doc_svd", components).transform(vectors)
    # What holds whatever the signs: orthonormal components, falling singular values, and no projection longer than its text.
    inner = [[sum(x * y for x, y in zip(a, b)) for b in components] for a in components]
    orthonormal = all(abs(inner[i][j] - (i == j)) < 1e-6 for i in range(len(inner)) for j in range(len(inner)))
    falling = all(a >= b for a, b in zip(values, values[1:]))
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda s, x: s + x * x)
    return projected.select(
        "doc_id", F.size(vector_to_array("doc_svd")).alias("n_components"), (square("doc_svd") <= square(fitted.output) + 1e-9).alias(
            "shorter"), F.lit(orthonormal).alias("orthonormal"), F.lit(falling).alias("falling"))


# --- Attribution consumers -------------------------------------------------------------------

@query
def attribution_topk(spark, sf):
    return A.attribution_topk(D.attribution_table(spark, sf)).select(
        "row_id", "rank", "feature", "label_text", "value", "attribution")


@query
def global_importance(spark, sf):
    return A.global_importance(D.attribution_table(spark, sf), 15).withColumns(_r6("importance"))


@query
def importance_summary(spark, sf):
    return A.importance_summary(D.attribution_table(spark, sf)).withColumn("top_features", F.array_join("top_features", ","))


@query
def feature_counterfactuals(spark, sf):
    return A.feature_counterfactuals(D.attribution_table(spark, sf), D.attribution_predictions(spark, sf))


@query
def dependence_points(spark, sf):
    return A.dependence_points(D.attribution_table(spark, sf))


# --- Models ----------------------------------------------------------------------------------

SETTINGS = models.LearnerSettings()
REPLICATES = 20
_trained: dict[tuple, object] = {}


def _once(name, spark, sf, build):
    """Keep fitted models per session and input; their tables lie in the shared folder."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _trained:
        _trained[key] = build()
    return _trained[key]


def _prepared(spark, sf):
    return _once("prepared", spark, sf, lambda: models.prepare(
        _labelled(spark, sf), "row_id", D.LEFT, D.RIGHT, D.RULES))


def _forest(spark, sf):
    return _once("forest", spark, sf, lambda: models.train_all(
        *_prepared(spark, sf), SETTINGS, ["Random Forest"]))


def _new_pairs(spark, sf):
    pairs = D.pair_table(spark, sf).select("left_name", "right_name").distinct()
    return pairs.select(F.upper("left_name").alias("left"), F.concat(F.lit(" "), "right_name").alias("right"))


@query
def leaderboard(spark, sf):
    trained = models.train_all(*_prepared(spark, sf), SETTINGS)
    return trained.leaderboard().withColumns(_r6(*METRICS))


@query
def score_pairs(spark, sf):
    scored = models.score_pairs(_new_pairs(spark, sf), _forest(spark, sf), "left", "right", left_dict=D.LEFT,
                                right_dict=D.RIGHT, rules=D.RULES)
    p = F.col("probability")
    consistent = p.between(0, 1) & (F.col("interaction_predicted") == (p > 0.5)) & (
        F.col("explanation.confidence_level") == S.confidence_band(p))
    return scored.select("left", "right", *RULE, "source", "recommendation",
                         F.coalesce(consistent, F.lit(False)).alias("consistent"))


def _explain_parts(spark, sf):
    def build():
        trained = _forest(spark, sf)
        space, train, test = _prepared(spark, sf)
        model = trained.models["Random Forest"]
        background = explain.background_rows(train, "row_id")
        rows = sampling.hash_sample(test, "row_id", 50)  # the explained sample is part of the operator
        return space, model, background, write_once(rows, "explained")

    return _once("explain", spark, sf, build)


def _shapley(spark, sf):
    space, model, background, rows = _explain_parts(spark, sf)
    return explain.shapley(rows, "row_id", model, background, space.groups, space.group_names)


def _lime(spark, sf):
    space, model, background, rows = _explain_parts(spark, sf)
    return explain.lime(rows, "row_id", model, background, space.groups, space.group_names)


@query
def shapley_exact(spark, sf):
    """Exact tree Shapley values of every test row, one-hot slots summed into their groups, with the base value
    and the forest's output per row, so additivity can be read from the table. The forest learns from every
    training row."""
    from pairsight.operators import tree_shap

    space, train, test = _prepared(spark, sf)
    forest = Forest(featuresCol="features", labelCol="label", weightCol="class_weight", numTrees=SETTINGS.trees,
                    maxDepth=SETTINGS.depth(15), minInstancesPerNode=2, cacheNodeIds=True, seed=42)
    model = forest.fit(train)
    long = write_once(tree_shap.tree_shap(test, "row_id", model, space.names), "exact-shapley")
    grouped = tree_shap.group_attributions(long, space.names, space.groups, space.group_names)
    totals = long.where(F.col("feature").isin("_base", "_output")).select("row_id", "feature", "attribution")
    return grouped.unionByName(totals).withColumns(_r6("attribution"))


@query
def shapley(spark, sf):
    return _shapley(spark, sf).withColumns(_r6("attribution"))


@query
def lime(spark, sf):
    return _lime(spark, sf).withColumns(_r6("weight"))


def _explained(spark, sf):
    _, _, _, rows = _explain_parts(spark, sf)
    scored = _forest(spark, sf).score(rows, "Random Forest")
    return explain.explained_rows(scored, "row_id", _shapley(spark, sf), _lime(spark, sf))


@query
def explained_rows(spark, sf):
    rows = _explained(spark, sf)
    return rows.select("row_id", "predicted_label", *_as(_r6("probability")),
                       F.array_join(F.transform("shap", lambda s: s["feature"]), ",").alias("shap"),
                       F.array_join(F.transform("lime", lambda s: s["feature"]), ",").alias("lime"))


@query
def uncertainty_bootstrap(spark, sf):
    _, train, test = _prepared(spark, sf)

    def forest(weight, seed):
        return Forest(featuresCol="features", labelCol="label", weightCol=weight, numTrees=SETTINGS.trees,
                      maxDepth=SETTINGS.depth(15), minInstancesPerNode=2, cacheNodeIds=True, seed=seed)

    predictions = explain.bootstrap_predictions(train, test, "row_id", forest, replicates=REPLICATES)
    summary = M.uncertainty_summary(predictions, ["row_id"])
    return summary.groupBy("uncertainty_level").agg(F.count("*").alias("n"), F.avg("std_probability").alias("mean_std"))


@query
def dashboard_query(spark, sf):
    space, train, test = _prepared(spark, sf)
    trained = _forest(spark, sf)
    correlations = A.vector_correlations(test, "features", space.names)
    return dashboard(trained.metrics, _labelled(spark, sf), trained.score(test, "Random Forest"), _shapley(spark, sf),
                     _explained(spark, sf), len(space.names), correlations).select(F.to_json(F.struct("*")).alias("record"))


@query
def predict_requests(spark, sf):
    """Requests over the pairs of the table (and a few names it lacks), answered as JSON."""
    pairs = D.pair_table(spark, sf)
    known = pairs.where(F.col("risk_level") == "HIGH").select("row_id", "left_name", "right_name", *override.DETAILS)
    asked = pairs.groupBy("left_name", "right_name").agg(F.min("row_id").alias("request_id"))
    right = F.when(F.col("left_name").contains("red"), F.lit("")).otherwise(F.col("right_name"))
    bodies = asked.select("request_id", F.to_json(F.struct(F.col("left_name").alias("drug"), right.alias("food"))).alias("body"))
    return service.answer_requests(bodies, "body", "request_id", _forest(spark, sf), known, "row_id", "Random Forest",
                                   D.LEFT, D.RIGHT, D.RULES)


# --- Streams ---------------------------------------------------------------------------------

def _event_stream(spark, sf):
    path = f"{sf}/events*.parquet"  # a pattern, so that one file and a folder both work
    stream = spark.readStream.schema(D.SCHEMAS["events"]).parquet(path)
    return jobs.enrich_requests(D.requests(stream), "body", D.EVENT_LEFT, D.EVENT_RIGHT, D.EVENT_RULES)


@query
def stream_rule_enrich(spark, sf):
    out, bad, state = (new_path(spark, n) for n in ("stream-scored", "stream-rejects", "stream-state"))
    jobs.run_scoring_stream(_event_stream(spark, sf), lambda batch: batch.withColumn("probability", _rule_probability()),
                            out, bad, state).awaitTermination()
    scored = spark.read.parquet(out).select("event_id", "left_name", "right_name", *RULE, "probability")
    rejects = spark.read.parquet(bad).select("event_id", "left_name", "right_name", *RULE)
    return scored.unionByName(rejects, allowMissingColumns=True)


@query
def stream_risk_counts(spark, sf):
    out, state = new_path(spark, "stream-counts"), new_path(spark, "stream-state")
    jobs.run_counts_stream(jobs.risk_counts(_event_stream(spark, sf), "ts"), out, state).awaitTermination()
    return jobs.latest_counts(spark.read.parquet(out)).select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "risk_level", "n")
