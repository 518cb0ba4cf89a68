"""Scalar rules over categories, mechanisms, risk levels and probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.functions.text import title_case


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Constant lookup as a CASE expression: no join for a handful of fixed entries."""
    if not table:
        return F.lit(default).cast("string")
    branches = iter(table.items())
    k, v = next(branches)
    case = F.when(key == k, F.lit(v))
    for k, v in branches:
        case = case.when(key == k, F.lit(v))
    return case.otherwise(F.lit(default))


def risk_score(risk: Column, mechanism: Column, left_category: Column, right_category: Column) -> Column:
    """1 to 5: base of the level, bonus for two mechanisms and for one category pair, capped."""
    base = F.when(risk == "HIGH", V.RISK_BASE["HIGH"]).when(risk == "MODERATE", V.RISK_BASE["MODERATE"])
    base = base.otherwise(V.RISK_BASE["LOW"])
    mech_bonus = F.when(mechanism.isin(V.BONUS_MECHANISMS), 1).otherwise(0)
    pair_bonus = F.when((left_category == V.BONUS_PAIR[0]) & (right_category == V.BONUS_PAIR[1]), 2).otherwise(0)
    return F.least(base + mech_bonus + pair_bonus, F.lit(V.RISK_CAP)).cast("int")


def confidence_band(p: Column) -> Column:
    return F.when(p > 0.7, "High").when(p > 0.4, "Medium").otherwise("Low")


def significance(risk: Column) -> Column:
    return F.when(risk == "HIGH", "Critical").when(risk == "MODERATE", "Important").otherwise("Monitor")


def decision_label(p: Column, threshold: float = 0.7) -> Column:
    return F.when(p > threshold, "INTERACTION").otherwise("NO INTERACTION")


def confidence_text(p: Column) -> Column:
    return F.format_string("%.3f", p)


def percent(p: Column) -> Column:
    """Round half up, as browsers do."""
    return F.floor(p * 100 + F.lit(0.5)).cast("bigint")


def acceptance(mechanism: Column, risk: Column) -> Column:
    """Chance with which a sampled unknown pair is kept as a negative."""
    case = F.when(mechanism == V.UNKNOWN, F.lit(V.ACCEPT_UNKNOWN))
    for level, chance in V.ACCEPT_BY_RISK.items():
        case = case.when(risk == level, F.lit(chance))
    return case.otherwise(F.lit(V.ACCEPT_DEFAULT))


def risk_change(base: Column, alternative: Column) -> Column:
    """INCREASED only towards HIGH, DECREASED only towards LOW; anything else is SAME."""
    up = (alternative == "HIGH") & (base != "HIGH")
    down = (alternative == "LOW") & (base != "LOW")
    return F.when(up, "INCREASED").when(down, "DECREASED").otherwise("SAME")


def personal_multiplier(age: Column, conditions: Column) -> Column:
    """1 + 0.2 (age over 65) + 0.3 (liver disease) + 0.2 (kidney disease); nulls add nothing."""
    def add(condition: Column, amount: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(amount)).otherwise(F.lit(0.0))

    steps = [
        add(age > 65, 0.2),
        add(F.array_contains(conditions, "liver_disease"), 0.3),
        add(F.array_contains(conditions, "kidney_disease"), 0.2),
    ]
    return reduce(lambda total, step: total + step, steps, F.lit(1.0))


def personal_probability(p: Column, age: Column, conditions: Column) -> Column:
    return F.least(p * personal_multiplier(age, conditions), F.lit(1.0))


def personal_message(age: Column, conditions: Column) -> Column:
    """Message text; a missing value is written ``None`` and a list with quoted items."""
    age_text = F.coalesce(age.cast("string"), F.lit("None"))
    quoted = F.transform(conditions, lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    list_text = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.concat(F.lit("Risk adjusted for age: "), age_text,
                    F.lit(", conditions: "), F.coalesce(list_text, F.lit("None")))


def feature_label(feature: Column) -> Column:
    """Readable feature name: the first token found gives the prefix and is removed everywhere."""
    case = None
    for token, prefix in V.FEATURE_TOKENS:
        text = F.concat(F.lit(prefix), F.replace(feature, F.lit(token), F.lit("")))
        hit = F.contains(feature, F.lit(token))
        case = F.when(hit, text) if case is None else case.when(hit, text)
    return case.otherwise(feature)


def is_domain_feature(feature: Column) -> Column:
    """True where the name contains one of the four tokens."""
    return feature.rlike("|".join(token for token, _ in V.FEATURE_TOKENS))


def mechanism_display(mechanism: Column) -> Column:
    words = title_case(F.replace(mechanism, F.lit("_"), F.lit(" ")))
    return F.when(mechanism != V.UNKNOWN, words).otherwise(V.MECHANISM_DISPLAY_DEFAULT)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Rescale to [0, 1]; a constant column gives 0."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def scrub(value: Column) -> Column:
    """Null, NaN and infinities become 0."""
    bad = value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(bad, F.lit(0.0)).otherwise(value)
