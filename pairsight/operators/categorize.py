"""Dictionary categories and the rule lookup over a pair of categories."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight import values as V
from pairsight.plans.shared import write_once

# Beyond this many terms the CASE-like expression gets too large to compile well.
INLINE_TERM_LIMIT = 400


@dataclass(frozen=True)
class CategoryDictionary:
    """Ordered categories with their keyword terms; the order breaks ties."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, entries) -> "CategoryDictionary":
        return cls(tuple((name, tuple(terms)) for name, terms in entries))

    @classmethod
    def from_table(cls, table: DataFrame) -> "CategoryDictionary":
        """Build from a ``(ord, category, term)`` table; dictionaries are small by nature."""
        grouped: dict[tuple[int, str], list[str]] = {}
        for row in table.select("ord", "category", "term").collect():
            grouped.setdefault((row["ord"], row["category"]), []).append(row["term"])
        return cls.of([(name, sorted(terms)) for (_, name), terms in sorted(grouped.items())])

    @property
    def names(self) -> list[str]:
        return [name for name, _ in self.entries]

    @property
    def labels(self) -> list[str]:
        """Every value the category column can take, sorted."""
        return sorted({*self.names, V.OTHER})

    @property
    def term_count(self) -> int:
        return sum(len(terms) for _, terms in self.entries)

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, term) for i, (name, terms) in enumerate(self.entries) for term in terms]
        return spark.createDataFrame(rows, "ord int, category string, term string")


LEFT = CategoryDictionary.of(V.LEFT_TERMS)
RIGHT = CategoryDictionary.of(V.RIGHT_TERMS)


def category_of(name: Column, dictionary: CategoryDictionary, word_boundary: bool = False) -> Column:
    """Category whose terms occur most often as substrings of the lower-cased name.

    The first category wins a tie and a name without any hit is ``other``. Each row is decided on
    its own, so there is no join and no shuffle, whatever the number of rows or repeated names.
    """
    if not dictionary.entries:
        return F.when(name.isNull(), F.lit(V.OTHER)).otherwise(F.lit(V.OTHER))
    if dictionary.term_count > INLINE_TERM_LIMIT:
        return _category_by_array(name, dictionary, word_boundary)
    lowered = F.coalesce(F.lower(name), F.lit(""))
    ranked = [
        F.struct(_hits(lowered, terms, word_boundary).alias("hits"), F.lit(-i).alias("rank"),
                 F.lit(category).alias("category"))
        for i, (category, terms) in enumerate(dictionary.entries)
    ]
    # The empty entry ranks above a category without hits and below any category with one.
    ranked.append(F.struct(F.lit(0).alias("hits"), F.lit(1).alias("rank"), F.lit(V.OTHER).alias("category")))
    return F.greatest(*ranked)["category"]


def _hits(text: Column, terms, word_boundary: bool) -> Column:
    if word_boundary:
        tests = [text.rlike(rf"\b{re.escape(t)}\b") for t in terms]
    else:
        tests = [F.contains(text, F.lit(t)) for t in terms]
    return reduce(lambda a, b: a + b, [t.cast("int") for t in tests], F.lit(0))


def _category_by_array(name: Column, dictionary: CategoryDictionary, word_boundary: bool) -> Column:
    lowered = F.coalesce(F.lower(name), F.lit(""))
    literal = F.array(*[
        F.struct(F.lit(-i).alias("rank"), F.lit(category).alias("category"),
                 F.array(*[F.lit(t) for t in terms]).alias("terms"))
        for i, (category, terms) in enumerate(dictionary.entries)
    ])

    def hit(term: Column) -> Column:
        if word_boundary:
            return F.regexp_like(lowered, F.concat(F.lit(r"\b\Q"), term, F.lit(r"\E\b")))
        return F.contains(lowered, term)

    scored = F.transform(literal, lambda c: F.struct(
        F.size(F.filter(c["terms"], hit)).alias("hits"), c["rank"].alias("rank"), c["category"].alias("category")))
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["category"]).otherwise(V.OTHER)


@dataclass(frozen=True)
class RuleTable:
    """(left category, right category) -> mechanism and risk level; the first entry of a key wins."""

    rows: tuple[tuple[str, str, str, str], ...]

    @classmethod
    def of(cls, rows) -> "RuleTable":
        seen, kept = set(), []
        for row in rows:
            if row[:2] not in seen:
                seen.add(row[:2])
                kept.append(tuple(row))
        return cls(tuple(kept))

    @property
    def mechanisms(self) -> list[str]:
        return sorted({r[2] for r in self.rows} | {V.UNKNOWN})

    def to_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            list(self.rows), "left_category string, right_category string, mechanism string, risk_level string")


RULES = RuleTable.of(V.RULES)


def rule_of(left_category: Column, right_category: Column, rules: RuleTable = RULES) -> Column:
    """Struct of mechanism and risk level; ``unknown`` and LOW where no rule applies.

    A literal map: the table is bounded by (left categories x right categories), so the lookup is
    an expression and rows are never moved for it.
    """
    default = F.struct(F.lit(V.UNKNOWN).alias("mechanism"), F.lit(V.DEFAULT_RISK).alias("risk_level"))
    case = None
    for left, right, mechanism, risk in rules.rows:
        value = F.struct(F.lit(mechanism).alias("mechanism"), F.lit(risk).alias("risk_level"))
        test = (left_category == left) & (right_category == right)
        case = F.when(test, value) if case is None else case.when(test, value)
    return default if case is None else case.otherwise(default)


def with_categories(pairs: DataFrame, left: str, right: str, left_dict: CategoryDictionary = LEFT,
                    right_dict: CategoryDictionary = RIGHT, word_boundary: bool = False) -> DataFrame:
    return pairs.withColumns({
        "left_category": category_of(F.col(left), left_dict, word_boundary),
        "right_category": category_of(F.col(right), right_dict, word_boundary),
    })


def with_rule(pairs: DataFrame, rules: RuleTable = RULES) -> DataFrame:
    """Append ``mechanism`` and ``risk_level`` from the two category columns."""
    rule = rule_of(F.col("left_category"), F.col("right_category"), rules)
    return pairs.withColumns({"mechanism": rule["mechanism"], "risk_level": rule["risk_level"]})


def with_rule_table(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """The same lookup against a rule table of any size; Spark picks the join from its statistics."""
    defaults = {"mechanism": V.UNKNOWN, "risk_level": V.DEFAULT_RISK}
    return pairs.join(rules, ["left_category", "right_category"], "left").na.fill(defaults)


def enrich(pairs: DataFrame, left: str, right: str, left_dict: CategoryDictionary = LEFT,
           right_dict: CategoryDictionary = RIGHT, rules: RuleTable = RULES) -> DataFrame:
    return with_rule(with_categories(pairs, left, right, left_dict, right_dict), rules)


# --- Dictionaries of any size: an n-gram index joined with the names --------------------------------------------

GRAM = 3               # characters of an index key
HOT_ROWS = 100_000     # names behind one index key before the key is split into salts


def _grams(text: Column, k: int) -> Column:
    """Distinct substrings of k characters; none for a shorter text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(0)))
    return F.array_distinct(F.filter(F.transform(starts, lambda i: F.substring(text, i, k)), lambda g: F.length(g) == k))


def category_by_index(names: DataFrame, name_col: str, terms: DataFrame, gram: int = GRAM,
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """(name, category) for each distinct value of ``name_col``, against an (ord, category, term) table of any size.

    The result equals ``category_of`` with the same dictionary: the category with the most term rows that are
    substrings of the lower-cased name, the smaller ``ord`` on a tie, ``other`` without a hit. Nothing is collected
    and the dictionary never enters the plan as a literal.

    Index: every distinct name gives its distinct ``gram``-character substrings (and, if the dictionary has shorter
    terms, its substrings of their lengths). Every term is anchored on one key: a shorter term on itself, a longer one
    on the substring of ``gram`` characters that the fewest names hold (the smallest on a tie), so that common
    keys are avoided. A name can hold a term only if it holds the term's anchor, so the equi-join on the anchor
    finds every candidate, and ``contains`` confirms it. An anchor held by more than ``hot_rows`` names is split
    into salts: names are dealt over them by a hash, the anchor's terms are copied to each. The table of such
    anchors has at most (rows of name keys) / ``hot_rows`` rows, so it is broadcast.

    Defined cases: a null name is ``other``; null and empty terms are dropped (an empty term would be a hit for
    every name); rows that repeat a term in a category count as often as they occur, as in ``category_of``; other
    columns are not read; an empty dictionary or table gives ``other`` or no rows.
    """
    spark = names.sparkSession
    distinct = names.select(F.col(name_col).alias("name")).distinct().withColumn(
        "lowered", F.coalesce(F.lower("name"), F.lit("")))
    rows = (terms.where(F.col("term").isNotNull() & (F.length("term") > 0))
            .groupBy("ord", "category", "term").agg(F.count("*").alias("mult")))
    # At most gram - 1 lengths come to the driver.
    short = sorted(r[0] for r in rows.select(F.length("term").alias("n")).where(F.col("n") < gram).distinct().collect())
    keyed = F.flatten(F.array(*[_grams(F.col("lowered"), k) for k in [*short, gram]]))
    name_keys = distinct.select("name", "lowered", F.explode(keyed).alias("key"))
    name_keys = write_once(name_keys, "category-name-keys")
    held = name_keys.groupBy("key").agg(F.count("*").alias("names"))
    words = rows.select("term").distinct()
    long_keys = words.where(F.length("term") >= gram).select("term", F.explode(_grams(F.col("term"), gram)).alias("key"))
    anchored = (long_keys.join(held, "key", "left").fillna({"names": 0})
                .groupBy("term").agg(F.min_by("key", F.struct("names", "key")).alias("key"))
                .unionByName(words.where(F.length("term") < gram).select("term", F.col("term").alias("key"))))
    hot = F.broadcast(held.where(F.col("names") > hot_rows)
                      .select("key", F.ceil(F.col("names") / hot_rows).cast("int").alias("salts")))
    name_side = name_keys.join(hot, "key", "left").withColumn(
        "salt", F.pmod(F.xxhash64("name"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    term_side = anchored.join(hot, "key", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    found = (name_side.join(term_side, ["key", "salt"]).where(F.contains(F.col("lowered"), F.col("term")))
             .select("name", "term"))
    hits = found.join(rows, "term").groupBy("name", "ord", "category").agg(F.sum("mult").alias("hits"))
    best = hits.groupBy("name").agg(F.max(F.struct("hits", (-F.col("ord")).alias("rank"), "category")).alias("b"))
    best = best.select("name", F.col("b.category").alias("category"))
    empty = spark.createDataFrame([], "name string, category string")
    return distinct.select("name").join(best.unionByName(empty), "name", "left").select(
        "name", F.coalesce("category", F.lit(V.OTHER)).alias("category"))
