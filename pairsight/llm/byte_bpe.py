"""Byte-level BPE by a segment tree over byte positions.

A match of the splitting pattern starts as single bytes. Position i holds the rank of the pair formed by the
live token at i and its next live neighbour; the tree's root is the leftmost minimum. Each merge joins
that pair, drops the right-hand position, and makes point updates, logarithmic in the match's length, at the
merged position, its left neighbour and the dropped position. Many matches of one tree size are worked on at
once in numpy; a long match is worked on alone, with the same tree in plain lists.

A token's id is its rank. A match that is itself a token has that token's id. Texts are cut before single spaces, where no
match can cross, and each distinct piece is matched and encoded once per worker.

Defined cases: null text is the empty text and has no ids; strings of special tokens are ordinary text; null
ids stay null; repeated rows are encoded each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pairsight.llm.arrow_text import as_text, slices, sum_by_document
from pairsight.llm.pieces import PieceCache, SpaceCut, encode_texts, flat_lists

NONE = np.int64(1) << 40   # rank of a pair that does not merge
BATCH_WIDTH = 64           # matches of up to so many bytes are merged together


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks, default=-1) + 1)]


class ByteBpe:
    """Encoder and decoder for one rank file and splitting pattern."""

    def __init__(self, tokens: Sequence[bytes], pattern: str):
        import regex

        self.tokens = list(tokens)
        self.rank = {t: i for i, t in enumerate(self.tokens) if t}
        self.matches = regex.compile(pattern).findall
        self.byte_ids = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("each single byte must be a token")
        pairs = {}
        for token, rank in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.slots(pairs)

    def slots(self, pairs: dict[int, int]) -> None:
        """An open-addressing table of the pairs, for lookups of whole arrays."""
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.values = np.full((1 << bits) + 64, NONE, np.int64)
        slot, rest = self.home(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], ranks[first]
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] += 1
        self.probes = int((slot - self.home(keys)).max(initial=0)) + 1

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        keys = left << 32 | right
        slot = self.home(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        rest = np.flatnonzero((out == NONE) & (self.keys[slot] >= 0))
        for _ in range(self.probes):
            if not len(rest):
                break
            slot[rest] += 1
            at = slot[rest]
            hit = self.keys[at] == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (self.keys[at] >= 0)]
        return out

    def merge_many(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (one word after the other) and numbers of ids of words of 2 to ``width`` bytes (a power of two), all trees side by side."""
        n, rows = len(words), np.arange(len(words))
        sizes = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        ids = self.byte_ids[raw]
        place = np.arange(width)
        left = np.tile(place - 1, (n, 1))
        right = np.tile(place + 1, (n, 1))
        # A node is rank << 8 | position, so its minimum is the leftmost pair of least rank.
        tree = np.full((n, 2 * width), NONE << 8, np.int64)
        live = place[None, 1:] < sizes[:, None]
        ranks = np.where(live, self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1), NONE)
        tree[:, width:2 * width - 1] = ranks << 8 | place[:-1]
        tree[:, 2 * width - 1] |= width - 1
        k = width
        while k > 1:
            tree[:, k // 2:k] = np.minimum(tree[:, k:2 * k:2], tree[:, k + 1:2 * k:2])
            k //= 2
        alive = np.ones((n, width), bool)

        def update(r: np.ndarray, p: np.ndarray, rank: np.ndarray) -> None:
            node = p + width
            tree[r, node] = rank << 8 | p
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        r = rows
        while True:
            r = r[tree[r, 1] < NONE << 8]
            if not len(r):
                break
            p, rank = tree[r, 1] & 255, tree[r, 1] >> 8
            q = right[r, p]                     # the position that is dropped
            after = right[r, q]
            ids[r, p], alive[r, q], right[r, p] = rank, False, after
            inner = after < sizes[r]
            left[r[inner], after[inner]] = p[inner]
            nothing = np.full(len(r), NONE)
            update(r, q, nothing)
            here = nothing.copy()
            here[inner] = self.pair_ranks(rank[inner], ids[r[inner], after[inner]])
            update(r, p, here)
            before = left[r, p]
            b = np.flatnonzero(before >= 0)
            if len(b):
                update(r[b], before[b], self.pair_ranks(ids[r[b], before[b]], rank[b]))
        alive &= place[None, :] < sizes[:, None]
        return ids[alive], alive.sum(axis=1)

    def merge_long(self, word: bytes) -> list[int]:
        """Encode one long word with the same tree, in plain lists."""
        size = len(word)
        width = 1 << (size - 1).bit_length()
        ids, get = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), self.pairs.get
        shift, none = 40, int(NONE) << 40
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        tree = [none] * (2 * width)
        for i in range(size - 1):
            rank = get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[width + i] = rank << shift | i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(p: int, rank: int | None) -> None:
            node = p + width
            tree[node] = none if rank is None else rank << shift | p
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    break
                tree[node] = low
                node >>= 1

        while tree[1] < none:
            p, rank = tree[1] & ((1 << shift) - 1), tree[1] >> shift
            q = right[p]
            after = right[q]
            ids[p], ids[q], right[p] = rank, -1, after
            if after < size:
                left[after] = p
            update(q, None)
            update(p, get(rank << 32 | ids[after]) if after < size else None)
            if left[p] >= 0:
                update(left[p], get(ids[left[p]] << 32 | rank))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the matches, one after the other, and each one's number of ids."""
        get = self.rank.get
        whole = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        widths = np.int64(1) << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        parts, order, counts = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)], (whole >= 0).astype(np.int64)
        for width in np.unique(widths[(whole < 0) & (sizes > 0)]):
            members = np.flatnonzero((whole < 0) & (widths == width) & (sizes > 0))
            chosen = [words[i] for i in members]
            ids, lengths = (self.merge_many(chosen, int(width)) if width <= BATCH_WIDTH
                            else flat_lists([self.merge_long(w) for w in chosen]))
            counts[members] = lengths
            parts.append(ids)
            order.append(np.repeat(members, lengths))
        owner = np.concatenate(order)
        return np.concatenate(parts)[np.argsort(owner, kind="stable")].astype(np.uint32), counts

    def encode_letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a space and letters are one match each."""
        return self.encode_words([p.encode() for p in pieces])

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Any pieces: the matches of each, encoded separately."""
        split = [self.matches(p) for p in pieces]
        ids, counts = self.encode_words([m.encode() for s in split for m in s])
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in split]))).astype(np.int64)
        return ids, sum_by_document(counts, offsets)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple[str, str], tuple[ByteBpe, PieceCache]] = {}


def loaded(path: str, pattern: str) -> tuple[ByteBpe, PieceCache]:
    """Encoder and cache, one of each per worker process."""
    if (path, pattern) not in _loaded:
        bpe = ByteBpe(read_ranks(path), pattern)
        _loaded[path, pattern] = bpe, PieceCache(bpe.encode_letters, bpe.encode_pieces)
    return _loaded[path, pattern]


def joined_ids(ids: np.ndarray) -> str:
    """Decimal ids joined by commas."""
    return ",".join(map(str, ids.tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           decode: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian, 4 bytes each).

    With ``decode``, the ids are decoded again in the same task, and ``decoded`` (bytes) and ``ids_text`` (decimal ids joined by
    commas) stand in place of ``ids``.
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = loaded(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode_texts(as_text(part.column("text")), cache, SpaceCut())
                rows = np.split(ids, np.cumsum(counts)[:-1])
                out = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64())}
                if decode:
                    out["decoded"] = pa.array([bpe.decode(x.tolist()) for x in rows], pa.binary())
                    out["ids_text"] = pa.array(map(joined_ids, rows), pa.string())
                else:
                    out["ids"] = pa.array([x.astype("<u4").tobytes() for x in rows], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kinds = "decoded binary, ids_text string" if decode else "ids binary"
    return narrow.mapInArrow(run, f"doc_id {narrow.dtypes[0][1]}, n_tokens long, {kinds}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` (bytes) to rows that hold ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(path)
        for batch in batches:
            for part in slices(batch, "ids"):
                ids = [np.frombuffer(b, "<u4").tolist() for b in part.column("ids").to_pylist()]
                columns = dict(zip(part.schema.names, part.columns))
                yield pa.RecordBatch.from_pydict({
                    **columns, "decoded": pa.array([b"".join(map(tokens.__getitem__, x)) for x in ids], pa.binary())})

    kinds = ", ".join(f"{c} {k}" for c, k in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")
