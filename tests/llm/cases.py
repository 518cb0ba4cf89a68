"""Small inputs shared by the tests of the training-data operators."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (0, ""), (1, None), (2, " \t\n"), (3, "one"), (4, "Two words"), (5, "a  b   c"), (6, " lead and trail "),
    (7, "x\n\ny\r\n z"), (8, "it's they're 12 345 foo_bar!!! ?"), (9, "Straße ÉCOLE ñandú 中文 \u00a0\u2003 \x1c \x85"),
    (10, "<|endoftext|> </s>[INST] ok [/INST]"), (11, "ab" * 3000), (12, "!?" * 400 + " " * 70), (13, "e\u0301 \u0301x"),
    (14, "same text here and there"), (15, "same text here and there"), (None, "no id"), (16, "twice"), (16, "twice"),
]


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def documents(spark, rows, partitions: int = 3):
    """A documents table with extra columns, some of whose names the operators use inside."""
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    frame = spark.createDataFrame(full, SCHEMA).repartition(partitions)
    return frame.selectExpr("*", "'x' AS cell", "1 AS score", "true AS kept", "'y' AS ids", "0 AS node")


def prose(seed: int, n: int, vocabulary: int = 300) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" + draw.choice(["", "", ",", ".", ".\n"]) for _ in range(n))
