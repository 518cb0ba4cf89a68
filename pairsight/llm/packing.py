"""Packing documents into training sequences: vector bin packing with a dot-product heuristic.

An example has three sizes: tokens, segments (one) and loss-bearing tokens. A sequence limits all three. Full
sequences are cut off a long document first. What remains waits in a block of examples; the block is
packed largest first, each example into the open sequence whose remaining capacities, in shares of the limits, have the
largest dot product with its sizes, among those it fits whole. Then the emptiest sequences are
taken apart and their segments cut to fill the gaps of the others. A sequence left short at the end of a task
is cut at the powers of two in its length, so that nothing is padded.

Each task packs its own documents: no shuffle, memory bounded by a block. Sequence ids are (partition, counter), so
a task that runs again gives the same ones.

Defined cases: null text is the empty text (its end id remains); a null id stays null; repeated rows are packed
each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pairsight.llm.arrow_text import as_text, lean, slices
from pairsight.llm.pieces import append_to_each, encode_texts, tokenizer_pieces, without_threads

SCHEMA = ("start long, length long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary")


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence and the number of examples packed at a time."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    block: int = 1024

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class Segment:
    """Part of an example: tokens [start, start + length) of its document; the first ``unscored`` bear no loss."""

    example: int
    start: int
    length: int
    unscored: int = 0

    @property
    def loss(self) -> int:
        return self.length - self.unscored

    def cut(self, at: int) -> tuple[Segment, Segment]:
        """The first ``at`` tokens and the rest."""
        head = min(self.unscored, at)
        return (Segment(self.example, self.start, at, head),
                Segment(self.example, self.start + at, self.length - at, self.unscored - head))


def place(segments: list[Segment], limits: Limits) -> list[list[Segment]]:
    """Dot-product placement of whole segments, largest first."""
    capacity, rooms, bins = limits.vector, np.zeros((len(segments), 3)), []
    for s in sorted(segments, key=lambda s: (-s.length, s.example, s.start)):
        size = np.array([s.length, 1, s.loss], float)
        room = rooms[:len(bins)]
        fits = np.flatnonzero((room >= size).all(axis=1))
        if len(fits):
            # Least capacity left over along the example's own direction: the tightest of those it fits.
            scores = (room[fits] / capacity) @ (size / capacity)
            chosen = int(fits[np.argmin(scores)])
        else:
            chosen = len(bins)
            bins.append([])
            rooms[chosen] = capacity
        bins[chosen].append(s)
        rooms[chosen] -= size
    return bins


def fill_gaps(bins: list[list[Segment]], limits: Limits) -> tuple[list[list[Segment]], list[Segment]]:
    """Take the emptiest sequences apart to fill the rest; returns full sequences and what is left over."""
    order = sorted(bins, key=lambda b: sum(s.length for s in b))
    done, loose = [], []
    while order:
        target = order.pop()  # the fullest
        while True:
            room = limits.tokens - sum(s.length for s in target)
            spare = limits.loss_tokens - sum(s.loss for s in target)
            if not room or not spare or len(target) >= limits.segments:
                break
            if not loose:
                if not order:
                    break
                loose = order.pop(0)[::-1]
            piece = loose.pop()
            size = min(piece.length, room, piece.unscored + spare)
            head, rest = piece.cut(size)
            target.append(head)
            if rest.length:
                loose.append(rest)
        full = not limits.tokens - sum(s.length for s in target)
        if full or len(target) >= limits.segments or not limits.loss_tokens - sum(s.loss for s in target):
            done.append(target)
        else:
            loose = target + loose
    return done, loose


def power_cuts(segments: list[Segment], limits: Limits) -> list[list[Segment]]:
    """Cut the leftover into sequences whose lengths are powers of two (and within the limits)."""
    out, rest = [], list(segments)
    while rest:
        total = min(sum(s.length for s in rest[:limits.segments]), limits.tokens)
        want, taken = 1 << (total.bit_length() - 1), []
        while want:
            head, tail = rest[0].cut(min(rest[0].length, want))
            if sum(s.loss for s in taken) + head.loss > limits.loss_tokens:
                break
            taken.append(head)
            want -= head.length
            rest = ([tail] if tail.length else []) + rest[1:]
        out.append(taken)
    return out


class Packer:
    """Packs a stream of examples; finished sequences come out as (sequence, offset, segment) rows."""

    def __init__(self, limits: Limits):
        self.limits, self.open = limits, []

    def add(self, segment: Segment) -> list[list[Segment]]:
        """Cut off full sequences; the remainder waits."""
        done = []
        whole = min(self.limits.tokens, self.limits.loss_tokens)
        while segment.length >= whole:
            head, segment = segment.cut(whole)
            done.append([head])
        if segment.length:
            self.open.append(segment)
        return done

    def flush(self, last: bool) -> list[list[Segment]]:
        """Pack the waiting block; the leftover waits for the next one, or is cut when there is none."""
        done, self.open = fill_gaps(place(self.open, self.limits), self.limits)
        if last:
            done += power_cuts(self.open, self.limits)
            self.open = []
        return done


def pack_documents(docs: DataFrame, path: str, kind: str = "byte", end_id: int | None = 1, limits: Limits = Limits(),
                   id_col: str = "doc_id", text_col: str = "text", kept_pieces: int | None = None) -> DataFrame:
    """One row per piece: document, place in it and in its sequence, and the ids (little-endian, 4 bytes each).

    Every token of a plain document bears loss. :class:`Segment` also takes examples that open with an
    unscored prompt. ``kept_pieces``: distinct pieces whose ids a worker keeps (by default the cache's own limit).
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_threads()
        cache, cut = tokenizer_pieces(path, kind, kept_pieces)
        packer, held, number = Packer(limits), {}, 0
        sequence = TaskContext.get().partitionId() << 40

        def rows(done: list[list[Segment]]) -> pa.RecordBatch:
            nonlocal sequence
            flat, places = [], []
            for members in done:
                offset = 0
                for s in members:
                    flat.append(s)
                    places.append((sequence, offset))
                    offset += s.length
                sequence += 1
            data = [held[s.example][1][s.start:s.start + s.length].tobytes() for s in flat]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([held[s.example][0] for s in flat], kind_of_id),
                "start": pa.array([s.start for s in flat], pa.int64()),
                "length": pa.array([s.length for s in flat], pa.int64()),
                "doc_tokens": pa.array([len(held[s.example][1]) for s in flat], pa.int64()),
                "sequence_id": pa.array([p[0] for p in places], pa.int64()),
                "offset": pa.array([p[1] for p in places], pa.int64()),
                "loss_tokens": pa.array([s.loss for s in flat], pa.int64()), "ids": pa.array(data, pa.binary())})

        def release() -> None:
            waiting = {s.example for s in packer.open}
            for k in [k for k in held if k not in waiting]:
                del held[k]

        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.schema.field("doc_id").type
            for part in slices(batch, "text"):
                ids, counts = encode_texts(as_text(part.column("text")), cache, cut)
                if end_id is not None:
                    ids, counts = append_to_each(ids, counts, end_id)
                ends = np.cumsum(counts)
                done = []
                for name, a, b in zip(part.column("doc_id").to_pylist(), ends - counts, ends):
                    held[number] = (name, ids[a:b].astype("<u4"))
                    done += packer.add(Segment(number, 0, int(b - a)))
                    number += 1
                if done:
                    yield rows(done)
                if len(packer.open) >= limits.block:
                    yield rows(packer.flush(last=False))
                release()
        if packer.open:
            yield rows(packer.flush(last=True))

    return narrow.mapInArrow(lean(run), f"doc_id {narrow.dtypes[0][1]}, {SCHEMA}")
