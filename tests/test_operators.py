from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.operators import attributions as A
from pairsight.operators import basket, batch, categorize as C, clean, counterfactual, features, lookups
from pairsight.operators import metrics as M
from pairsight.operators import ordering as O
from pairsight.operators import override, sampling, search, similar
from pairsight.plans import skew

EXPECTED = [
    ("warfarin", "spinach", "anticoagulant", "leafy_greens", "vitamin_k_competition", "HIGH", 5),
    ("simvastatin", "grapefruit", "statin", "citrus", "cyp3a4_inhibition", "HIGH", 5),
    ("aspirin", "alcohol", "pain_relief", "alcohol", "gi_bleeding_risk", "MODERATE", 2),
    ("amoxicillin", "milk", "antibiotic", "dairy", "calcium_chelation", "MODERATE", 2),
    ("metformin", "banana", "diabetes", "high_potassium", "unknown", "LOW", 1),
    ("ibuprofen", "coffee", "pain_relief", "caffeinated", "unknown", "LOW", 1),
]


def test_example_pairs(spark):
    pairs = spark.createDataFrame(V.EXAMPLE_PAIRS, "left_name string, right_name string")
    rows = features.pair_features(C.enrich(pairs, "left_name", "right_name")).select(
        "left_name", "right_name", "left_category", "right_category", "mechanism", "risk_level", "risk_score").collect()
    assert {tuple(r) for r in rows} == set(EXPECTED)


TRAPS = [("cheese", "dairy"), ("Broccoli", "leafy_greens"), ("orange juice", "citrus"), ("chocolate", "caffeinated"),
         ("steak", "caffeinated"), ("", "other"), (None, "other"), ("bread", "other")]


def test_category_traps(spark):
    frame = spark.createDataFrame(TRAPS, "n string, want string")
    rows = frame.select("want", C.category_of(F.col("n"), C.RIGHT).alias("inline"),
                        C._category_by_array(F.col("n"), C.RIGHT, False).alias("array")).collect()
    assert all(r["want"] == r["inline"] == r["array"] for r in rows)


def test_word_boundary_and_left_traps(spark):
    frame = spark.createDataFrame([("steak",), ("iced tea",)], "n string")
    assert [r[0] for r in frame.select(C.category_of(F.col("n"), C.RIGHT, word_boundary=True)).collect()] == ["other", "caffeinated"]
    left = spark.createDataFrame([("esomeprazole",), ("prednisolone",)], "n string")
    assert [r[0] for r in left.select(C.category_of(F.col("n"), C.LEFT)).collect()] == ["ppi", "steroid"]


def test_dictionary_table_round_trip(spark):
    again = C.CategoryDictionary.from_table(C.LEFT.to_table(spark))
    assert again.names == C.LEFT.names and again.term_count == C.LEFT.term_count


def test_rule_table_join_equals_expression(spark):
    pairs = spark.createDataFrame([(a, b) for a, b, *_ in V.RULES] + [("x", "y")], "left_category string, right_category string")
    one = {tuple(r) for r in C.with_rule(pairs).collect()}
    assert one == {tuple(r) for r in C.with_rule_table(pairs, C.RULES.to_table(spark)).collect()}


def test_clean_pairs_dedups_before_cleaning(spark):
    raw = spark.createDataFrame(
        [("Aspirin", "Milk"), ("Aspirin", "Milk"), ("aspirin ", "milk"), (None, "milk"), ("ab", "milk"), ("123", "milk"),
         ("low-fat", "tea leaf")], "a string, b string")
    rows = sorted(tuple(r) for r in clean.clean_pairs(raw, "a", "b").collect())
    assert rows == [("aspirin", "milk", 1), ("aspirin", "milk", 1), ("lowfat", "tea leaf", 1)]
    assert clean.clean_pairs(raw, "a", "b", dedup_after_clean=True).count() == 2


def test_swapped_pairs(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "a"), ("c", "d"), ("e", "e")], "left_name string, right_name string")
    assert [tuple(r) for r in clean.swapped_pairs(pairs).collect()] == [("a", "b", 1, 2)]


# --- Order without a global sort -------------------------------------------------------------

def test_running_totals_match_brute_force(spark):
    rng = random.Random(7)
    # Most scores crowd into a narrow range.
    scores = sorted({round(rng.choice([rng.random(), 0.5 + rng.random() / 1e6]), 9) for _ in range(800)}, reverse=True)
    rows = [(s, rng.randint(0, 5), rng.randint(0, 5)) for s in scores]
    frame = spark.createDataFrame(rows, "s double, a bigint, b bigint")
    for buckets in (1, 7, 256):
        got = O.running_totals(frame, "s", ["a", "b"], buckets).orderBy(F.desc("s")).collect()
        total_a = total_b = 0
        for row, (s, a, b) in zip(got, rows, strict=True):
            total_a, total_b = total_a + a, total_b + b
            assert (row["s"], row["cum_a"], row["cum_b"]) == (s, total_a, total_b)
            assert row["all_a"] == sum(r[1] for r in rows)


def test_dense_position_is_a_bijection(spark):
    frame = spark.range(1000).select((F.col("id") * 7).alias("k"))
    got = sorted(r["p"] for r in O.dense_position(frame, "k", "p").collect())
    assert got == list(range(1000))
    again = {r["k"]: r["p"] for r in O.dense_position(frame.repartition(5), "k", "p").collect()}
    assert again == {r["k"]: r["p"] for r in O.dense_position(frame.coalesce(1), "k", "p").collect()}


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_stratified_split_sizes_and_partition_invariance(spark, share):
    frame = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7 == 0).cast("int").alias("label"))
    split = sampling.stratified_split(frame, "label", "k", share)
    sizes = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert sizes == {k: v for k, v in {0: round(857 * share), 1: round(143 * share)}.items() if v}
    again = sampling.stratified_split(frame.repartition(3), "label", "k", share)
    assert sorted(split.collect()) == sorted(again.collect())


# --- Hot keys --------------------------------------------------------------------------------

def test_salted_join_equals_plain_join(spark):
    probe = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(tuple(r) for r in probe.join(table, "k", "left").select("id", "k", "v").collect())
    salted = skew.join_unique(probe, table, ["k"], "id").select("id", "k", "v")
    assert sorted((tuple(r) for r in salted.collect())) == want
    for limit in (0, 1000):
        got = skew.lookup_join(probe, table, ["k"], "id", limit).select("id", "k", "v").collect()
        assert sorted(tuple(r) for r in got) == want


def test_known_override_first_row_wins(spark):
    known = spark.createDataFrame(
        [(2, "Aspirin", "milk", 1, "a", "b", "m", "HIGH"), (1, "aspirin", "Milk", 0, "c", "d", "n", "LOW")],
        "rid int, l string, r string, label int, left_category string, right_category string, mechanism string, risk_level string")
    targets = spark.createDataFrame(
        [(10, "ASPIRIN", "milk", "x", "x", "x", "x", True, 0.9), (11, "other", "milk", "x", "y", "u", "LOW", True, 0.6)],
        "t int, l string, r string, left_category string, right_category string, mechanism string, risk_level string, "
        "interaction_predicted boolean, p double")
    rows = {r["t"]: r for r in override.known_override(targets, known, "l", "r", "rid", "t", "p").collect()}
    assert (rows[10]["p"], rows[10]["interaction_predicted"], rows[10]["source"], rows[10]["left_category"]) == (
        0.0, False, "known_database", "c")
    assert (rows[11]["p"], rows[11]["source"]) == (0.6, "model_prediction")


# --- Lists by category -----------------------------------------------------------------------

def test_similar_lists_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, f"l{i}", rng.choice("abc"), rng.choice("xyz"), rng.randint(0, 1)) for i in range(200)]
    known = spark.createDataFrame(rows, "rid int, name string, left_category string, right_category string, label int")
    targets = known.select("left_category", "right_category").distinct()
    loose = similar.similar_loose(targets, known, "rid", ["name"], "label", 3).collect()
    strict = similar.similar_strict(targets, known, "rid", ["name"], 5).collect()
    for a in "abc":
        for b in "xyz":
            want = [n for _, n, l, r, y in rows if (l == a or r == b) and y == 1][:3]
            assert [r["similar_name"] for r in sorted(loose, key=lambda r: r["rank"]) if (r[0], r[1]) == (a, b)] == want
            want = [n for _, n, l, r, _ in rows if (l, r) == (a, b)][:5]
            assert [r["similar_name"] for r in sorted(strict, key=lambda r: r["rank"]) if (r[0], r[1]) == (a, b)] == want
    nested = similar.similar_lists(targets.union(spark.createDataFrame([("q", "q")], targets.schema)), known, "rid", ["name"])
    assert {len(r["similar"]) for r in nested.collect() if r["left_category"] == "q"} == {0}


def test_batch_is_left_major_and_capped(spark):
    lefts = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "position bigint, name string")
    rights = spark.createDataFrame([(0, "x"), (1, "y")], "position bigint, name string")
    full = [(r["left_name"], r["right_name"]) for r in batch.combinations(lefts, rights, None).orderBy("combo_id").collect()]
    assert full == [(a, b) for a in "abc" for b in "xy"]
    assert [(r[1], r[2]) for r in batch.combinations(lefts, rights, 3).orderBy("combo_id").collect()] == full[:3]


def test_baskets_match_brute_force(spark):
    baskets = spark.createDataFrame(
        [("b1", ["p", "q"], ["x", "y"]), ("b2", ["r"], ["y"]), ("b3", [], ["x"])], "basket string, lefts array<string>, rights array<string>")
    lefts, rights = basket.explode_baskets(baskets, "basket", "lefts", "rights")
    scores = spark.createDataFrame(
        [("p", "x", True, 0.9), ("q", "x", True, 0.6), ("q", "y", True, 0.5), ("r", "y", False, 0.9)],
        "left_name string, right_name string, interaction_predicted boolean, probability double")
    alerts = basket.alert_pairs(scores)
    rows = {r["basket"]: (r["safe"], r["n_interactions"]) for r in basket.basket_compat(
        lefts, rights, alerts, "basket", "left_name", "right_name").collect()}
    assert rows == {"b1": (False, 2), "b2": (True, 0), "b3": (True, 0)}
    listed = basket.basket_alerts(lefts, rights, alerts, "basket", "left_name", "right_name").collect()
    assert sorted((r["basket"], r["left_name"], r["right_name"]) for r in listed) == [("b1", "p", "x"), ("b1", "q", "x")]


def test_counterfactuals_of_a_known_pair(spark):
    pairs = spark.createDataFrame([("anticoagulant", "leafy_greens"), ("other", "alcohol")], "left_category string, right_category string")
    rows = counterfactual.counterfactual_rules(pairs).collect()
    first = sorted((r for r in rows if r["left_category"] == "anticoagulant"), key=lambda r: r["rank"])
    assert [r["scenario"] for r in first][:2] == ["Using a statin medication instead", "Using a antibiotic medication instead"]
    assert {r["risk_change"] for r in first} == {"DECREASED"}
    other = sorted((r for r in rows if r["left_category"] == "other"), key=lambda r: r["rank"])
    assert [(r["scenario"], r["risk_change"]) for r in other[:2]] == [
        ("Using a antidepressant medication instead", "INCREASED"), ("Using a diabetes medication instead", "INCREASED")]
    odd = spark.createDataFrame([("never seen", "alcohol")], pairs.schema)
    outside = sorted(counterfactual.counterfactual_rules(odd).collect(), key=lambda r: r["rank"])
    assert [r["scenario"] for r in outside] == [r["scenario"] for r in other] and outside[0]["left_category"] == "never seen"
    summary = {r["left_category"]: r for r in counterfactual.counterfactual_summary(pairs).collect()}
    assert len(summary["anticoagulant"]["safer_alternatives"]) == 5
    assert len(summary["other"]["riskier_alternatives"]) == 2


def test_lookups_and_defaults(spark):
    rows = spark.createDataFrame(
        [("HIGH", "cyp3a4_inhibition", "Warfarin"), ("HIGH", "cns_depression", "zzz"), ("MODERATE", "bp_elevation", "metformin"),
         ("LOW", "acid_suppression_interference", "x"), ("?", "?", "x")], "r string, m string, n string")
    got = rows.select(
        lookups.monitoring_advice(F.col("r"), F.col("m")).alias("mon"), lookups.explanation(F.col("m")).alias("exp"),
        lookups.recommendation(F.col("r")).alias("rec"), lookups.short_advice(F.col("r")).alias("short"),
        lookups.mechanism_details(F.col("m")).alias("d"), lookups.alternatives(F.col("n")).alias("alt")).collect()
    assert got[0]["mon"].startswith("Monitor for signs of drug toxicity")
    assert got[1]["mon"].startswith("Monitor for any unusual") and got[4]["mon"] == V.MONITORING_DEFAULT
    assert got[3]["exp"] == V.MECHANISM_TEXT["unknown"] and got[4]["rec"] == V.RISK_TEXT["LOW"]
    assert got[4]["short"] == V.SHORT_ADVICE_DEFAULT
    assert got[2]["d"]["timing"] == "Consult healthcare provider"
    assert got[0]["alt"]["foods_to_avoid"] == ["spinach", "kale", "broccoli"] and got[0]["alt"]["message"] is None
    assert got[2]["alt"]["foods_to_avoid"] == [] and got[1]["alt"]["message"] == V.ALTERNATIVES_DEFAULT


# --- Statistics and metrics ------------------------------------------------------------------

def test_search_and_stats(spark):
    pairs = spark.createDataFrame([("Tea", "x"), ("steak", "x"), (None, "y"), ("milk", None)], "l string, r string")
    assert [r["name"] for r in search.search_entities(pairs, "l", "TEA").collect()] == ["Tea", "steak"]
    assert [r["name"] for r in search.search_entities(pairs, "l", limit=2).collect()] == ["Tea", "milk"]
    assert tuple(search.pair_stats(pairs, "l", "r").head()) == (4, 3, 2, True)
    assert search.feature_types(pairs) == {"string": 2}
    weights = search.class_weights(spark.createDataFrame([(1,), (1,), (1,), (0,)], "label int"), "label").collect()
    assert sorted(tuple(r) for r in weights) == [(0, 1, 2.0, 1 / 3), (1, 3, 2 / 3, 1 / 3)]


def brute_metrics(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap = last = 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        called = [y for y, p in rows if p >= t]
        recall, precision = sum(called) / len(pos), sum(called) / len(called)
        ap, last = ap + (recall - last) * precision, recall
    return auc, ap


@pytest.mark.parametrize("seed", [1, 2])
def test_metrics_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 1), round(rng.random(), rng.choice([1, 3]))) for _ in range(300)]
    frame = spark.createDataFrame([(y, int(p > 0.5), p) for y, p in rows], "label int, prediction int, p double")
    got = M.evaluate(frame).head()
    auc, ap = brute_metrics(rows)
    assert got["roc_auc"] == pytest.approx(auc) and got["avg_precision"] == pytest.approx(ap)
    assert got["accuracy"] == pytest.approx(sum(y == (p > 0.5) for y, p in rows) / 300)
    all_points = M.roc_points(frame, drop_intermediate=False, buckets=5)
    corners = M.roc_points(frame, buckets=5)
    full = sorted((r["fp"], r["tp"]) for r in all_points.collect())
    kept = sorted((r["fp"], r["tp"]) for r in corners.collect())
    assert set(kept) <= set(full) and kept[0] == (0, 0) and kept[-1] == full[-1]
    def area(points):
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area(kept) == pytest.approx(area(full))


def test_metrics_of_one_class_and_constant_prediction(spark):
    frame = spark.createDataFrame([(1, 0, 0.2), (1, 0, 0.3)], "label int, prediction int, p double")
    got = M.evaluate(frame).head()
    assert (got["roc_auc"], got["avg_precision"], got["precision"], got["f1"]) == (0.0, 0.0, 0.0, 0.0)
    assert {(r["label"], r["prediction"]): r["n"] for r in M.confusion(frame).collect()} == {(0, 0): 0, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_calibration_edges(spark):
    rows = [(1, 0.0), (0, 0.1), (1, 0.1 * 3), (1, 0.3), (0, 1.0)] * 10
    frame = spark.createDataFrame(rows, "label int, p double")
    bins = {r["bin"]: r["n"] for r in M.calibration_bins(frame).collect()}
    assert bins == {0: 10, 2: 20, 9: 10}  # 0.0 lies in no bin; 3 x 0.1 still belongs to (0.2, 0.3...]
    assert M.calibration_error(frame).head()["error"] is None
    few = M.calibration_error(frame.limit(49)).head()
    assert few["expected_calibration_error"] is None and few["error"].startswith("Insufficient")


def test_uncertainty_and_vote(spark):
    frame = spark.createDataFrame([("a", i, int(i > 5), i / 10) for i in range(11)], "row_id string, replicate int, prediction int, p double")
    row = M.uncertainty_summary(frame, ["row_id"]).head()
    assert row["mean_probability"] == pytest.approx(0.5) and row["ci_lower"] == pytest.approx(0.025)
    assert row["uncertainty_level"] == "HIGH" and row["prediction_stability"] == pytest.approx(5 / 11)
    votes = spark.createDataFrame([(0.2, 0.9), (0.5, 0.5)], "a double, b double")
    assert [r["vote"] for r in M.soft_vote(votes, ["a", "b"]).collect()] == [1, 0]
    with pytest.raises(ValueError):
        M.soft_vote(votes, ["a"])


def test_attribution_queries(spark):
    rows = [(1, "drug_a", 1.0, 0.5), (1, "food_b", 1.0, -0.7), (1, "risk_x", 0.0, 0.0), (1, "name_similarity", 0.3, 0.9),
            (2, "drug_a", 0.0, 0.1), (2, "food_b", 1.0, 0.1)]
    table = spark.createDataFrame(rows, "row_id int, feature string, value double, attribution double")
    top = A.attribution_topk(table, base_value=0.4).orderBy("row_id", "rank").collect()
    assert [(r["row_id"], r["feature"]) for r in top] == [(1, "food_b"), (1, "drug_a"), (2, "drug_a"), (2, "food_b")]
    assert top[0]["label_text"] == "Food type: b" and top[0]["base_value"] == 0.4
    summary = A.importance_summary(table).head()
    assert (summary["left_features"], summary["right_features"], summary["interaction_features"]) == (1, 1, 1)
    assert summary["top_features"] == ["food_b", "drug_a", "risk_x"]
    predictions = spark.createDataFrame([(1, 1), (2, 0)], "row_id int, prediction int")
    changes = A.feature_counterfactuals(table, predictions).orderBy("row_id", "rank").collect()
    assert [r["feature"] for r in changes] == ["drug_a", "risk_x", "food_b", "drug_a", "food_b"]
    assert A.feature_counterfactuals(table, predictions, target_class=1).select("row_id").distinct().collect() == [(2,)]
    assert {r["feature"] for r in A.dependence_points(table, 1).collect()} == {"name_similarity"}


def test_alignment_and_scaling(spark):
    wide = spark.createDataFrame([(1, 1, 5)], "id int, drug_b int, drug_z int")
    assert tuple(features.align_features(wide, ["drug_a", "drug_b"], ["id"]).head()) == (1, 0.0, 1.0)
    frame = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    assert [tuple(r)[2:] for r in features.standardize(frame, ["a", "b"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert features.one_hot(wide, "drug_b", ["1", "2"], "x").columns[-2:] == ["x_1", "x_2"]


def test_negatives(spark):
    rows = [(l, r) for l in range(40) for r in range(30) if (l * 7 + r) % 3]
    names = V.SYNTHETIC_LEFT
    pairs = spark.createDataFrame([(l, r, names[l % 20], V.SYNTHETIC_RIGHT[r % 20]) for l, r in rows], "l int, r int, ln string, rn string")

    def draw(frame):
        return sampling.sample_negatives(frame, "l", "r", "ln", "rn")

    first = sorted(tuple(x) for x in draw(pairs).select("draw_id", "left_key", "right_key", "label").collect())
    assert len(first) == int(len(rows) * 0.8)
    assert not {(x[1], x[2]) for x in first} & set(rows)
    assert first == sorted(tuple(x) for x in draw(pairs.repartition(3)).select("draw_id", "left_key", "right_key", "label").collect())
    full = spark.createDataFrame([(l, r, "x", "y") for l in range(3) for r in range(3)], "l int, r int, ln string, rn string")
    assert draw(full).count() == 0  # every pair is known: the attempts run out
