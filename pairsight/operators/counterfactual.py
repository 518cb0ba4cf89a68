"""What if one side had another category?

The answer depends on the pair of categories only. It is worked out once per category pair (a table
made from the dictionaries and the rules, without reading any rows) and looked up by each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.functions.scoring import risk_change
from pairsight.operators.categorize import LEFT, RIGHT, RULES, CategoryDictionary, RuleTable, rule_of

PAIR = ["left_category", "right_category"]
FIELDS = ["rank", "scenario", "original_risk", "counterfactual_risk", "risk_change", "mechanism_change"]

# Scenario wording per side.
SCENARIO_LEFT = "Using a %s medication instead"
SCENARIO_RIGHT = "Consuming a %s food instead"


# A category that neither the dictionaries nor the rules know.
OUTSIDE = ""


def _categories(dictionary: CategoryDictionary, in_rules: set[str]) -> list[str]:
    return sorted({*dictionary.labels, *in_rules, OUTSIDE})


def _key(category: str, known: list[str]):
    return F.when(F.col(category).isin(known), F.col(category)).otherwise(F.lit(OUTSIDE))


def category_scenarios(spark: SparkSession, left_dict: CategoryDictionary = LEFT, right_dict: CategoryDictionary = RIGHT,
                       rules: RuleTable = RULES, top: int = 5) -> DataFrame:
    """Per category pair, the first ``top`` scenarios: increases, then same, then decreases."""
    options = [(i, "L", c) for i, c in enumerate(left_dict.names)]
    options += [(len(options) + i, "R", c) for i, c in enumerate(right_dict.names)]
    literal = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(side).alias("side"), F.lit(c).alias("category"))
        for i, side, c in options])
    lefts = _categories(left_dict, {r[0] for r in rules.rows})
    rights = _categories(right_dict, {r[1] for r in rules.rows})
    base = spark.createDataFrame([(c,) for c in lefts], f"{PAIR[0]} string").withColumn(
        PAIR[1], F.explode(F.array(*[F.lit(c) for c in rights])))
    rows = base.withColumn("_o", F.explode(literal))
    on_left = F.col("_o.side") == "L"
    alternative = F.col("_o.category")
    rows = rows.where(alternative != F.when(on_left, F.col(PAIR[0])).otherwise(F.col(PAIR[1])))
    new_left = F.when(on_left, alternative).otherwise(F.col(PAIR[0]))
    new_right = F.when(on_left, F.col(PAIR[1])).otherwise(alternative)
    rows = rows.withColumn("_base", rule_of(F.col(PAIR[0]), F.col(PAIR[1]), rules)).withColumn(
        "_alt", rule_of(new_left, new_right, rules))
    change = risk_change(F.col("_base.risk_level"), F.col("_alt.risk_level"))
    weight = F.when(change == "INCREASED", 2).when(change == "SAME", 1).otherwise(0)
    scenario = F.when(on_left, F.format_string(SCENARIO_LEFT, alternative)).otherwise(
        F.format_string(SCENARIO_RIGHT, alternative))
    order = W.partitionBy(*PAIR).orderBy(F.desc(weight), F.col("_o.ord"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        *PAIR, "rank", scenario.alias("scenario"), F.col("_base.risk_level").alias("original_risk"),
        F.col("_alt.risk_level").alias("counterfactual_risk"), change.alias("risk_change"),
        F.col("_alt.mechanism").alias("mechanism_change"))


def _lookup(pairs: DataFrame, table: DataFrame, left_dict: CategoryDictionary, right_dict: CategoryDictionary,
            rules: RuleTable) -> DataFrame:
    """Inner join of every pair with its category pair's rows; the table is bounded by the dictionaries."""
    keyed = pairs.withColumns({
        "_kl": _key(PAIR[0], _categories(left_dict, {r[0] for r in rules.rows})),
        "_kr": _key(PAIR[1], _categories(right_dict, {r[1] for r in rules.rows})),
    })
    named = table.withColumnsRenamed({PAIR[0]: "_kl", PAIR[1]: "_kr"})
    return keyed.join(F.broadcast(named), ["_kl", "_kr"]).drop("_kl", "_kr")


def counterfactual_rules(pairs: DataFrame, left_dict: CategoryDictionary = LEFT,
                         right_dict: CategoryDictionary = RIGHT, rules: RuleTable = RULES, top: int = 5) -> DataFrame:
    """Each pair with its ranked scenarios, one row per scenario."""
    table = category_scenarios(pairs.sparkSession, left_dict, right_dict, rules, top)
    return _lookup(pairs, table, left_dict, right_dict, rules)


def counterfactual_summary(pairs: DataFrame, left_dict: CategoryDictionary = LEFT,
                           right_dict: CategoryDictionary = RIGHT, rules: RuleTable = RULES,
                           top: int = 5) -> DataFrame:
    """Each pair with three scenario lists: safer, riskier and similar."""
    table = category_scenarios(pairs.sparkSession, left_dict, right_dict, rules, top)
    item = F.struct("rank", "scenario", "counterfactual_risk", "mechanism_change", "risk_change")
    lists = table.groupBy(*PAIR).agg(F.sort_array(F.collect_list(item)).alias("_all"))  # <= `top` items

    def pick(kind: str):
        return F.filter("_all", lambda s: s["risk_change"] == kind)

    summary = lists.select(*PAIR, pick("DECREASED").alias("safer_alternatives"),
                           pick("INCREASED").alias("riskier_alternatives"), pick("SAME").alias("similar_risk"))
    return _lookup(pairs, summary, left_dict, right_dict, rules)
