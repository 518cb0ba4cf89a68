"""Repetition rules for documents.

Words are ``[^\\x20\\x09-\\x0D]+``. For n-gram lengths 5 to 10, rolling 64-bit hashes over word codes find
the windows that occur twice or more in a text, and the share of word characters inside them is
compared with a limit per length. Likewise for characters in lines equal to an earlier line. Each
document is judged by itself in one pass: no shuffle.

Defined cases: null or empty text has 0 words and fails the base rule; null ids stay null; repeated rows
are judged each; other columns are passed through by :func:`keep_good` and ignored by
:func:`repetition_table`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pairsight.llm.arrow_text import Words, as_text, lean, mix64, parts_of, slices, split_words, sum_by_document

SYMBOLS = r"[#*$%&|<>]"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "line_share double, gram_shares array<double>, base_failed boolean, kept boolean")


@dataclass(frozen=True)
class QualityRules:
    """Limits. ``gram_limits``: n -> largest share of word characters inside repeated n-grams."""

    min_words: int = 50
    max_repeat_percent: int = 50
    base_gram: int = 3
    gram_limits: dict[int, float] = field(default_factory=lambda: {
        5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    max_line_share: float = 0.20


def repeated_windows(hashes: np.ndarray, positions: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """Those positions whose n-word window occurs at another position of the same document."""
    if not len(positions):
        return positions
    key = mix64(documents[positions].astype(np.uint64) + np.uint64(1))
    for k in range(n):
        key = key * FACTOR + hashes[positions + k]
    key = mix64(key)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return positions[twice]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which word positions lie in a window of n words from one of the starts."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition(words: Words, rules: QualityRules) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Word characters, words in repeated base windows, and characters in repeated n-grams, per document."""
    chars = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)[words.codes]
    hashes = mix64(np.arange(1, len(words.vocab) + 1, dtype=np.uint64))[words.codes]
    size, documents, base = len(words.codes), words.documents, rules.base_gram
    left = np.repeat(words.offsets[1:], words.counts) - np.arange(size)  # words from here to the document's end
    starts = repeated_windows(hashes, np.flatnonzero(left >= base), documents, base)
    in_base = covered(starts, base, size)
    # A longer window repeats only where each base window in it does: count them from each start on.
    run = np.zeros(size + 1, np.int64)
    run[starts] = 1
    ends = np.flatnonzero(run == 0)
    run = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size) if size else run[:0]
    inside = []
    for n in sorted(rules.gram_limits):
        where = np.flatnonzero((run >= n - base + 1) & (left >= n))
        marked = covered(repeated_windows(hashes, where, documents, n), n, size)
        inside.append(sum_by_document(chars * marked, words.offsets))
    return (sum_by_document(chars, words.offsets), sum_by_document(in_base.astype(np.int64), words.offsets), inside)


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines equal to an earlier line, their characters, and all characters of lines with a word, per document."""
    codes, offsets, vocab = parts_of(pc.split_pattern(texts, "\n"))
    has_word = pc.not_equal(pc.ascii_trim_whitespace(vocab), "").to_numpy(zero_copy_only=False)[codes]
    chars = pc.utf8_length(vocab).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    documents = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    again = np.ones(len(codes), bool)
    again[np.unique(documents * (len(vocab) + 1) + codes, return_index=True)[1]] = False
    again &= has_word
    by = lambda v: sum_by_document(v.astype(np.int64), offsets)
    return by(again), by(chars * again), by(chars * has_word)


def judge(texts: pa.Array, rules: QualityRules) -> dict[str, pa.Array]:
    """All figures and the verdict for each text."""
    words = split_words(texts)
    n_words = words.counts.astype(np.int64)
    word_chars, repeat, inside = repetition(words, rules)
    dup_lines, dup_chars, line_chars = duplicate_lines(texts)
    shares = [x / np.maximum(word_chars, 1) for x in inside]
    line_share = dup_chars / np.maximum(line_chars, 1)
    failed = (n_words < rules.min_words) | (100 * repeat > rules.max_repeat_percent * n_words)
    good = ~failed & (line_share <= rules.max_line_share)
    for n, share in zip(sorted(rules.gram_limits), shares):
        good &= share <= rules.gram_limits[n]
    table = np.stack(shares, axis=1) if shares else np.zeros((len(n_words), 0))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()),
                                     pa.array(table.ravel()))
    symbols = pc.count_substring_regex(texts, pattern=SYMBOLS).cast(pa.int64())
    return {"n_words": pa.array(n_words), "word_chars": pa.array(word_chars), "n_symbols": symbols,
            "n_dup_lines": pa.array(dup_lines), "n_repeat_words": pa.array(repeat), "line_share": pa.array(line_share),
            "gram_shares": lists, "base_failed": pa.array(failed), "kept": pa.array(good)}


def repetition_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: QualityRules | None = None) -> DataFrame:
    """One row per document: id, figures, ``base_failed`` and ``kept``."""
    rules = rules or QualityRules()
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = judge(as_text(part.column("text")), rules)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **found})

    return narrow.mapInArrow(lean(run), f"doc_id {narrow.dtypes[0][1]}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: QualityRules | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = rules or QualityRules()
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.field(place).name):
                yield part.filter(judge(as_text(part.column(place)), rules)["kept"])

    return docs.mapInArrow(lean(run), docs.schema)
