from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.functions import scoring as S
from pairsight.functions import text as T
from pairsight.functions.hashing import u60, uniform


def apply(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in frame.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def python_clean(text: str) -> str:
    text = re.sub(r"[^a-zA-Z\s]", "", text.lower().strip())
    return re.sub(r"\s+", " ", text)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ19 \t\n\x0b\x1c\x85\xa0 　é-'ß"), max_size=12), min_size=30, max_size=60))
def test_clean_text_matches_python(spark, names):
    assert apply(spark, names, T.clean_text) == [python_clean(n) for n in names]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ19 '-_é."), max_size=12), min_size=30, max_size=60))
def test_title_case_and_jaccard_match_python(spark, names):
    assert apply(spark, names, T.title_case) == [n.title() for n in names]
    other = "ab z"
    expected = [len(set(n) & set(other)) / max(len(set(n) | set(other)), 1) for n in names]
    assert apply(spark, names, lambda c: T.char_jaccard(c, F.lit(other))) == pytest.approx(expected)


def test_clean_keeps_a_trailing_space_left_by_removal(spark):
    assert apply(spark, ["vitamin b12 1", "low-fat"], T.clean_text) == ["vitamin b ", "lowfat"]


def test_bands_and_labels(spark):
    p = [0.0, 0.4, 0.41, 0.7, 0.71]
    assert apply(spark, p, S.confidence_band, "double") == ["Low", "Low", "Medium", "Medium", "High"]
    assert apply(spark, p, S.decision_label, "double")[-2:] == ["NO INTERACTION", "INTERACTION"]
    assert apply(spark, [0.0005, 0.5], S.confidence_text, "double")[1] == "0.500"
    assert apply(spark, [0.125, 0.005, 0.004], S.percent, "double") == [13, 1, 0]
    names = ["drug_statin", "food_drug_x", "risk_score", "mechanism_a_mechanism_b", "name_similarity"]
    assert apply(spark, names, S.feature_label) == [
        "Medication type: statin", "Medication type: food_x", "Risk level: score", "Interaction cause: a_b", "name_similarity"]
    assert apply(spark, names, S.is_domain_feature) == [True, True, True, True, False]
    assert apply(spark, ["unknown", "gi_bleeding_risk"], S.mechanism_display) == ["Not fully understood", "Gi Bleeding Risk"]


def test_risk_score_and_change(spark):
    rows = [("HIGH", "vitamin_k_competition", "anticoagulant", "leafy_greens", 5), ("HIGH", "cns_depression", "x", "y", 4),
            ("LOW", "unknown", "anticoagulant", "leafy_greens", 3), ("MODERATE", "m", "x", "y", 2), ("?", "m", "x", "y", 1)]
    frame = spark.createDataFrame(rows, "r string, m string, a string, b string, want int")
    got = frame.select(S.risk_score(*[F.col(c) for c in "rmab"]).alias("s"), "want").collect()
    assert all(r["s"] == r["want"] for r in got)
    pairs = [("LOW", "HIGH", "INCREASED"), ("HIGH", "HIGH", "SAME"), ("HIGH", "LOW", "DECREASED"),
             ("LOW", "MODERATE", "SAME"), ("HIGH", "MODERATE", "SAME"), ("MODERATE", "LOW", "DECREASED")]
    frame = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r[0] == r[1] for r in frame.select(S.risk_change(F.col("a"), F.col("b")), "want").collect())


def test_personal_adjustment(spark):
    people = spark.createDataFrame(
        [(70, ["liver_disease", "kidney_disease"]), (65, []), (None, None), (80, ["asthma"])], "age int, conditions array<string>")
    rows = people.select(S.personal_multiplier(F.col("age"), F.col("conditions")).alias("m"),
                         S.personal_message(F.col("age"), F.col("conditions")).alias("t")).collect()
    assert [round(r["m"], 6) for r in rows] == [1.7, 1.0, 1.0, 1.2]
    assert rows[0]["t"] == "Risk adjusted for age: 70, conditions: ['liver_disease', 'kidney_disease']"
    assert rows[1]["t"].endswith("conditions: []") and rows[2]["t"].endswith("age: None, conditions: None")


def test_scrub_and_minmax(spark):
    assert apply(spark, [float("nan"), float("inf"), None, 2.0], S.scrub, "double") == [0.0, 0.0, 0.0, 2.0]


def test_uniform_is_a_function_of_the_key(spark):
    values = spark.range(2000).select(uniform(F.lit(1), F.col("id")).alias("u"), u60(F.lit(1), F.col("id")).alias("k"))
    row = values.agg(F.min("u"), F.max("u"), F.avg("u"), F.count_distinct("k")).head()
    assert 0 <= row[0] and row[1] < 1 and abs(row[2] - 0.5) < 0.03 and row[3] == 2000


def test_fixed_tables_have_the_expected_sizes():
    assert (len(V.LEFT_TERMS), len(V.RIGHT_TERMS), len(V.RULES)) == (11, 10, 11)
    assert len(V.MECHANISM_TEXT) == 11 and len(V.SYNTHETIC_LEFT) == len(V.SYNTHETIC_RIGHT) == 20
