"""Text expressions. All are plain Column expressions, so they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All Unicode whitespace plus the four separators x1c-x1f. Java's \s is ASCII-only,
# and an explicit class is matched faster than its Unicode mode.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace (``trim`` alone removes only spaces)."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(text: Column) -> Column:
    """Lower-case, strip, drop all but ASCII letters and whitespace, collapse whitespace runs.

    A space left at the end by the removal stays: nothing is stripped afterwards.
    """
    letters = F.regexp_replace(strip(F.lower(text)), rf"[^a-z{SPACE}]+", "")
    return F.regexp_replace(letters, rf"[{SPACE}]+", " ")


def normalize_query(text: Column) -> Column:
    """Lower-case and strip a name typed by a user."""
    return strip(F.lower(text))


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the others.

    ``initcap`` starts words only after a space, so ``o'brien vitamin-k`` needs its own split.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two strings' character sets (a space counts as a character)."""
    left, right = _chars(a), _chars(b)
    union = F.size(F.array_union(left, right))
    return F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1))


def _chars(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(text, "")))


def words_display(mechanism: Column) -> Column:
    """``gi_bleeding_risk`` -> ``Gi Bleeding Risk``."""
    return F.initcap(F.replace(mechanism, F.lit("_"), F.lit(" ")))


def contains_ignore_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))
