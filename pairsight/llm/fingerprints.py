"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. Each level of the parse works on the previous level's sequence:

1. Runs of one repeated symbol become one symbol named by the symbol and the run's length.
2. Deterministic coin tossing: four times, each symbol takes 2j + b, where j is the lowest bit in which it differs
   from its left neighbour and b its own bit there. Neighbours stay different, and the labels end below 6.
3. A block starts at the first symbol and at every local maximum of the labels, so blocks have 1 to 11 symbols.
4. A block's name is a hash of the names of its symbols; the names are the next level's sequence.

Whether a position starts a block depends only on a few symbols around it, so equal substrings are parsed alike
away from their ends, and share their interior phrase names whatever their offset in the text. A text's
fingerprint is the ``sketch`` smallest distinct names (as signed 64-bit integers) of all its phrases, level 1 and
up, written as 16 lowercase hex digits each in ascending order. Likeness of two fingerprints is the bottom-k
estimate of the Jaccard similarity of the phrase sets: among the ``sketch`` smallest names of their union, the
share that lies in both; two empty fingerprints have likeness 1, an empty and a non-empty one 0.

The query's edited text of a document replaces its last floor(n / 3) code points by the first as many (or all) of
the next document in descending doc_id; after the last comes the first. The documents are range-partitioned by
that order once and each partition is walked in order; the last row of a partition is resolved against the first
row of the next non-empty partition in tables of one row per partition.

Defined cases: null text is the empty text (no phrases, fingerprint ''); the order is doc_id descending with null
ids last, rows with equal doc_id ordered by two hashes of their text, descending; rows equal in doc_id and text
are interchangeable and each has its own output row; a single document is its own next; very long texts are parsed
whole; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import mix64

SKETCH = 64              # names kept in a fingerprint
ROUNDS = 4               # coin-tossing rounds: 64-bit labels -> below 6
RUN_SALT = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
MARGIN = 2               # multiple of a sketch that is sorted of each document's names
SLICE_CHARS = 1 << 20    # code points parsed together; a longer text is a slice of its own
DONE, TAIL, HEAD = 0, 1, 2
WALK_SCHEMA = ("kind int, part int, doc_id long, n_chars long, text string, edited_sha256 string, names array<long>, "
               "kept long, added array<long>, near_edited double, near_next double")
RESULT_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, names array<long>, edited_names array<long>, "
                 "near_edited double, near_next double")


def _lowest_bit(d: np.ndarray) -> np.ndarray:
    low = d & (~d + np.uint64(1))
    return (low.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)   # exact: low is a power of two


def _toss_table() -> np.ndarray:
    """Next label of every (left, own) pair of labels below 128, at left * 128 + own."""
    left, own = np.divmod(np.arange(1 << 14, dtype=np.uint64), np.uint64(128))
    differ = left ^ own
    differ[differ == 0] = 1          # only after a hash collision
    j = _lowest_bit(differ)
    return (np.uint64(2) * j + ((own >> j) & np.uint64(1))).astype(np.uint8)


TOSS = _toss_table()                 # the first round's labels are below 128, so later rounds look theirs up


def _level(x: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level of the parse over many documents laid end to end; ``first`` marks each document's first symbol."""
    change = first.copy()
    change[1:] |= x[1:] != x[:-1]
    run_start = np.flatnonzero(change)
    run_len = np.diff(np.append(run_start, len(x))).astype(np.uint64)
    sym, rdoc, rfirst = x[run_start], doc[run_start], first[run_start]
    meta = np.where(run_len > 1, mix64(sym ^ mix64(run_len + RUN_SALT)), sym)
    left = np.empty_like(meta)
    left[1:] = meta[:-1]
    left[rfirst] = meta[rfirst] ^ np.uint64(1)
    differ = meta ^ left
    differ[differ == 0] = 1          # only after a hash collision
    j = _lowest_bit(differ)
    label = (np.uint64(2) * j + ((meta >> j) & np.uint64(1))).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        before = np.empty(len(label), np.uint16)
        before[1:] = label[:-1]
        before[rfirst] = label[rfirst] ^ np.uint8(1)
        label = TOSS[before << np.uint16(7) | label]
    m = len(label)
    last = np.ones(m, bool)
    last[:-1] = rfirst[1:]
    above_left = np.zeros(m, bool)
    above_left[1:] = label[1:] > label[:-1]
    above_right = np.ones(m, bool)
    above_right[:-1] = label[:-1] > label[1:]
    start = rfirst | (~rfirst & above_left & (last | above_right))
    block_start = np.flatnonzero(start)
    block_len = np.diff(np.append(block_start, m))
    position = np.arange(m) - np.repeat(block_start, block_len)
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(block_len.max()) - 1, BASE, np.uint64))), dtype=np.uint64)
    total = np.add.reduceat(meta * powers[position], block_start)
    names = mix64(total ^ mix64(block_len.astype(np.uint64)))
    return names, rdoc[block_start], rfirst[block_start]


def phrase_names(texts: list[str], sketch: int = SKETCH) -> list[np.ndarray]:
    """The fingerprint of each text as ascending signed 64-bit names; see the module docstring."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    x = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.int64), lengths)
    first = np.zeros(len(x), bool)
    first[np.cumsum(lengths)[lengths > 0] - lengths[lengths > 0]] = True
    found_names, found_docs = [], []
    size = lengths
    while len(x):
        x, doc, first = _level(x, doc, first)
        found_names.append(x)
        found_docs.append(doc)
        new_size = np.bincount(doc, minlength=n)
        going = (new_size > 1) & (new_size < size)
        keep = going[doc]
        x, doc, first, size = x[keep], doc[keep], first[keep], np.where(going, new_size, 0)
    if not found_names:
        return [np.zeros(0, np.int64) for _ in range(n)]
    names = np.concatenate(found_names).view(np.int64)
    docs = np.concatenate(found_docs)
    # Names are hashes, so about MARGIN * sketch names of a document lie below that share of the range of names. Only
    # these are sorted; a document that has fewer than ``sketch`` distinct ones among them (repetitive texts) is
    # sorted whole.
    sizes = np.bincount(docs, minlength=n)
    share = np.minimum(MARGIN * sketch / np.maximum(sizes, 1), 1.0)
    limit = np.where(share < 1, (share * 2.0 ** 64 - 2.0 ** 63).clip(-2.0 ** 63, 2.0 ** 63 - 1025), 0).astype(np.int64)
    limit[share >= 1] = np.iinfo(np.int64).max
    low = names <= limit[docs]
    picked, picked_docs = _distinct(names[low], docs[low])
    short = (np.bincount(picked_docs, minlength=n) < sketch) & (share < 1)
    if short.any():
        keep, whole = ~short[picked_docs], short[docs]
        rest, rest_docs = _distinct(names[whole], docs[whole])
        picked, picked_docs = np.concatenate((picked[keep], rest)), np.concatenate((picked_docs[keep], rest_docs))
        order = np.argsort(picked_docs, kind="stable")
        picked, picked_docs = picked[order], picked_docs[order]
    starts = np.searchsorted(picked_docs, np.arange(n + 1))
    return [picked[starts[i]:min(starts[i + 1], starts[i] + sketch)] for i in range(n)]


def _distinct(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, name) pairs in ascending order."""
    order = np.argsort(names)
    names, docs = names[order], docs[order]
    if len(docs) and docs.max() < 1 << 16:
        docs = docs.astype(np.uint16)          # numpy sorts 16-bit integers by radix
    order = np.argsort(docs, kind="stable")
    names, docs = names[order], docs[order].astype(np.int64)
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])
    return names[fresh], docs[fresh]


def likeness(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Bottom-k Jaccard estimate of two fingerprints; ``likeness_column`` is the same in SQL."""
    lowest = np.union1d(a, b)[:sketch]
    if not len(lowest):
        return 1.0
    return float(np.isin(lowest, np.intersect1d(a, b)).sum() / len(lowest))


def likeness_rows(a: list[np.ndarray], b: list[np.ndarray], sketch: int = SKETCH) -> np.ndarray:
    """``likeness`` of each pair of fingerprints."""
    n, width = len(a), max((len(x) + len(y) for x, y in zip(a, b)), default=0)
    laid = np.full((n, width + 1), np.iinfo(np.int64).max)
    sizes = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64)
    laid[np.arange(width + 1) < sizes[:, None]] = np.concatenate([v for pair in zip(a, b) for v in pair] or [np.zeros(0, np.int64)])
    laid.sort(axis=1)
    inside = np.arange(width) < sizes[:, None]
    twice = (laid[:, 1:] == laid[:, :-1]) & (np.arange(1, width + 1) < sizes[:, None])   # a name of both, at its first place
    fresh = inside.copy()
    fresh[:, 1:] &= ~twice[:, :-1]
    lowest = fresh & (np.cumsum(fresh, axis=1) <= sketch)
    total = lowest.sum(axis=1)
    return np.where(total > 0, (lowest & twice).sum(axis=1) / np.maximum(total, 1), 1.0)


def likeness_column(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    lowest = F.slice(F.array_sort(F.array_union(a, b)), 1, sketch)
    both = F.size(F.array_intersect(lowest, F.array_intersect(a, b)))
    return F.when(F.size(lowest) == 0, F.lit(1.0)).otherwise(both / F.size(lowest))


def fingerprint_text(names: Column) -> Column:
    """16 lowercase hex digits per name, in the array's (ascending) order."""
    return F.array_join(F.transform(names, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


def _names_of(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints of many texts, in slices of about SLICE_CHARS code points."""
    out, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= SLICE_CHARS:
            out.extend(phrase_names(texts[start:i + 1]))
            start, total = i + 1, 0
    out.extend(phrase_names(texts[start:]))
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted partition: each row with its follower; the partition's first and last rows go out unresolved."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    carry = None                      # the last row seen, waiting for its follower
    head_sent = False
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids = batch.column(0).to_pylist()
        texts = pc.fill_null(batch.column(1), "").to_pylist()
        names = _names_of(texts)
        rows = ([carry] if carry else []) + list(zip(ids, texts, names))
        out = []
        if not head_sent:
            out.append((HEAD, ids[0], len(texts[0]), texts[0], None, names[0], None, None, None))
            head_sent = True
        out.extend((DONE, *row) for row in _finished(rows[:-1], rows[1:]))
        carry = rows[-1]
        yield _rows(part, out)
    if carry:
        yield _rows(part, [(TAIL, carry[0], len(carry[1]), carry[1], None, carry[2], None, None, None)])


def _finished(rows: list[tuple], followers: list[tuple]) -> list[tuple]:
    """(doc_id, n_chars, None, edited_sha256, names, edited_names, near_edited, near_next) of rows whose follower is known."""
    edited = [_edited(text, follower[1]) for (_, text, _), follower in zip(rows, followers)]
    own, changed = [r[2] for r in rows], _names_of(edited)
    near_edited, near_next = likeness_rows(own, changed), likeness_rows(own, [f[2] for f in followers])
    return [(doc_id, len(text), None, hashlib.sha256(new.encode()).hexdigest(), names, new_names, near, following)
            for (doc_id, text, names), new, new_names, near, following in zip(rows, edited, changed, near_edited, near_next)]


def _change(own: np.ndarray, changed: np.ndarray) -> tuple[int, np.ndarray]:
    """A fingerprint as its difference from another: which of the other's names it keeps (bit i: name i), and its own ones."""
    if not len(own) or not len(changed):
        return 0, changed
    at = np.minimum(changed.searchsorted(own), len(changed) - 1)
    hit = changed[at] == own
    new = np.ones(len(changed), bool)
    new[at[hit]] = False
    return int.from_bytes(np.packbits(hit, bitorder="little").tobytes().ljust(8, b"\0"), "little", signed=True), changed[new]


def _changed(names: Column, kept: Column, added: Column) -> Column:
    """The fingerprint that ``_change`` split."""
    return F.array_sort(F.concat(F.filter(names, lambda x, i: F.getbit(kept, i) == 1), added))


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    rows = [np.zeros(0, np.int64) if r is None else r for r in rows]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _rows(part: int, out: list[tuple]) -> pa.RecordBatch:
    kind, doc_id, n_chars, text, digest, own, changed, near_edited, near_next = (list(c) for c in zip(*out))
    # The edited text shares most of its phrases with its document, so only what differs is stored.
    kept, added = zip(*((0, None) if new is None else _change(old, new) for old, new in zip(own, changed)))
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(kind, pa.int32()), "part": pa.array([part] * len(out), pa.int32()),
        "doc_id": pa.array(doc_id, pa.int64()), "n_chars": pa.array(n_chars, pa.int64()), "text": pa.array(text, pa.string()),
        "edited_sha256": pa.array(digest, pa.string()), "names": _lists(own), "kept": pa.array(kept, pa.int64()),
        "added": _lists(added), "near_edited": pa.array(near_edited, pa.float64()),
        "near_next": pa.array(near_next, pa.float64())})


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of partitions with the first row of the next partition: (doc_id, text, names, next_text, next_names)."""
    for batch in batches:
        column = lambda i: batch.column(i).to_pylist()
        as_names = lambda values: [np.array(v or [], np.int64) for v in values]
        rows = list(zip(column(0), [t or "" for t in column(1)], as_names(column(2))))
        followers = list(zip(column(0), [t or "" for t in column(3)], as_names(column(4))))
        done = _finished(rows, followers)
        doc_id, n_chars, _, digest, own, changed, near_edited, near_next = (list(c) for c in zip(*done)) if done else [[]] * 8
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc_id, pa.int64()), "n_chars": pa.array(n_chars, pa.int64()),
            "edited_sha256": pa.array(digest, pa.string()), "names": _lists(own), "edited_names": _lists(changed), "near_edited": pa.array(near_edited, pa.float64()),
            "near_next": pa.array(near_next, pa.float64())})


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, names, edited_names (fingerprints as arrays of names), near_edited, near_next."""
    spark = docs.sparkSession
    order = (F.desc_nulls_last("doc_id"), F.desc("_h1"), F.desc("_h2"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                           F.xxhash64(text).alias("_h1"), F.hash(text).alias("_h2"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    from pairsight.plans.shared import write_once

    walked = write_once(ordered.mapInArrow(_walk, WALK_SCHEMA), "fingerprint-walk")
    # Partitions are ranges in order; a tail's follower is the head of the next non-empty partition, the last
    # tail's the first head. One row per partition on each side.
    parts = sorted(r["part"] for r in walked.where(F.col("kind") == HEAD).select("part").collect())
    following = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, head int")
    heads = walked.where(F.col("kind") == HEAD).select(F.col("part").alias("head"), F.col("text").alias("next_text"),
                                                       F.col("names").alias("next_names"))
    tails = (walked.where(F.col("kind") == TAIL).join(F.broadcast(following), "part").join(heads, "head")
             .select("doc_id", "text", "names", "next_text", "next_names").mapInArrow(_resolve, RESULT_SCHEMA))
    restored = walked.withColumn("edited_names", _changed(F.col("names"), F.col("kept"), F.col("added")))
    done = restored.where(F.col("kind") == DONE).select(*[c.split()[0] for c in RESULT_SCHEMA.split(", ")])
    return done.unionByName(tails)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """The query's columns: fingerprints as hex text, likeness to the edited text and to the next document."""
    found = fingerprint(docs)
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint_text("names").alias("fingerprint"),
                        fingerprint_text("edited_names").alias("edited_fingerprint"), "near_edited", "near_next")
