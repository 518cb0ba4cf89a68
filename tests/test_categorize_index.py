"""Categories from dictionaries of any size: the n-gram index join against the expression form and brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairsight.operators import categorize as C


def _by_index(spark, names, dictionary: C.CategoryDictionary, **settings) -> dict:
    frame = spark.createDataFrame([(n,) for n in names], "n string").repartition(3)
    found = C.category_by_index(frame, "n", dictionary.to_table(spark), **settings)
    return {r["name"]: r["category"] for r in found.collect()}


def _by_expression(spark, names, dictionary: C.CategoryDictionary) -> dict:
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    return {r[0]: r[1] for r in frame.select("n", C.category_of(F.col("n"), dictionary)).collect()}


def _brute(names, entries) -> dict:
    out = {}
    for name in names:
        lowered = (name or "").lower()
        scores = [(sum(t in lowered for t in terms if t), -i, c) for i, (c, terms) in enumerate(entries)]
        best = max(scores) if scores else (0, 0, "other")
        out[name] = best[2] if best[0] > 0 else "other"
    return out


def test_index_equals_expression_with_short_terms_repeats_and_nulls(spark):
    draw = random.Random(7)
    letters = "abcdeé"
    dictionary = C.CategoryDictionary.of([
        ("first", ["ab", "a", "abc", "abc", "dé"]),        # short terms, a repeated term
        ("second", ["bca", "cab", "é", "ddd"]),
        ("third", ["abcab", "bc", "abc"]),                  # a term shared with "first": the tie goes to "first"
        ("empty", []),
    ])
    names = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 9))) for _ in range(300)]
    names += [None, "", "ABC", "Abcab", "zzz", "x" * 5000 + "cab"]
    expected = _by_expression(spark, names, dictionary)
    assert _by_index(spark, names, dictionary) == expected
    # Every key hot: names are dealt over salts and the anchors' terms copied to each; same answer.
    assert _by_index(spark, names, dictionary, hot_rows=3) == expected
    assert expected == _brute(names, dictionary.entries)


def test_empty_dictionary_and_empty_table(spark):
    empty = C.CategoryDictionary.of([])
    assert _by_index(spark, ["a", None], empty) == {"a": "other", None: "other"}
    assert _by_index(spark, [], C.LEFT) == {}


def test_hundred_thousand_terms_against_brute_force(spark):
    """A dictionary of 100,000 generated terms in 50 categories, built and joined without any collect."""
    syllables = ["ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "ve", "zu"]
    word = lambda i: "".join(syllables[(i // 10 ** p) % 10] for p in range(5))
    terms = spark.range(100_000).select(
        (F.col("id") % 50).cast("int").alias("ord"), F.concat(F.lit("c"), (F.col("id") % 50).cast("string")).alias("category"),
        F.expr("concat(" + ", ".join(f"element_at(array({', '.join(repr(s) for s in syllables)}), "
                                      f"CAST(floor(id / {10 ** p}) % 10 AS INT) + 1)" for p in range(5)) + ")").alias("term"))
    draw = random.Random(3)
    names = [word(draw.randrange(100_000)) + word(draw.randrange(100_000))[:draw.randrange(11)] for _ in range(200)]
    names += ["KALOMINUPE", "plain", None]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r["name"]: r["category"] for r in C.category_by_index(frame, "n", terms).collect()}
    entries = [(f"c{k}", [word(i) for i in range(k, 100_000, 50)]) for k in range(50)]
    assert found == _brute(names, entries)
    assert sum(v != "other" for v in found.values()) >= 200
