"""Columnar text helpers used inside tasks: slices of a batch, words, lines, ragged gathers.

A *word* is a run of characters outside ASCII white space, ``[^\\x20\\x09-\\x0D]+``. All helpers take
Arrow string arrays, read null as the empty text, and return numpy arrays with document offsets.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text of one step of numpy work. It bounds a task's memory; a longer document is a slice of its own.
SLICE_BYTES = 2 << 20

Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def as_text(column: pa.Array) -> pa.Array:
    """The column as strings; null becomes the empty text."""
    return pc.fill_null(column.cast(pa.string()), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch with about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Return the memory that this process has freed to the system. Arrow and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Task) -> Task:
    """The task, made to give back freed memory after each batch and at its end: a worker process outlives its tasks, and an
    executor's memory holds what all its workers keep."""

    def batch_by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch_by_batch(batches))
        give_back()

    return task


@dataclass
class Words:
    """Words of a slice: ``vocab[codes]`` in order; document i has codes[offsets[i]:offsets[i + 1]]."""

    codes: np.ndarray
    offsets: np.ndarray
    vocab: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def parts_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes, offsets and dictionary of a list column's elements."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0], coded.dictionary


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """The words of each text; ``lower`` folds A-Z first."""
    codes, offsets, vocab = parts_of(pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts))
    empty = pc.index(vocab, "").as_py() if len(vocab) else -1
    if empty < 0:
        return Words(codes, offsets, vocab)
    keep = codes != empty
    before = np.concatenate(([0], np.cumsum(keep)))
    codes = codes[keep]
    codes -= codes > empty
    kept = pa.concat_arrays([vocab.slice(0, empty), vocab.slice(empty + 1)])
    return Words(codes, before[offsets], kept)


def sum_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each document."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[offsets[1:]] - total[offsets[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or ends[-1] == 0:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads consecutive integers over all bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def word_hashes(vocab: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocab.to_pylist()), np.uint64, len(vocab))


def binary_rows(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next ``lengths[i]`` elements of ``data``, as raw bytes."""
    ends = np.concatenate(([0], np.cumsum(lengths))) * data.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())
