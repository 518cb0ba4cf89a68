"""Encoding with a vocabulary, one distinct piece at a time.

A text is cut where no token can cross, each distinct piece is encoded once, and ids are gathered per text
with numpy. Natural text repeats its words, so most pieces come from the cache. A word's final comma or
full stop is a piece of its own. The ids equal those of the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairsight.llm.arrow_text import parts_of, ragged, split_words, sum_by_document

MAX_PIECES = 1_000_000    # distinct pieces kept, and their characters; beyond either the cache starts
MAX_CHARS = 32_000_000    # afresh, which gives the same ids with more work
_SPACE = r"[\s\p{Z}\x{85}\x1c-\x1f]"
JOINED = 4096             # letter-only pieces encoded in one call

Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after the other, and each list's length."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


class PieceCache:
    """Ids of distinct pieces, kept in one flat array.

    ``letters`` encodes pieces of letters (those of the cut; after one space, for byte-level vocabularies); ``others``
    encodes any piece. Index 0 is the piece without ids.
    """

    def __init__(self, letters: Encoder, others: Encoder, limit: int | None = None):
        self.letters, self.others, self.limit = letters, others, limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.chars = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)

    def indices(self, pieces: list[str], simple: np.ndarray) -> np.ndarray:
        """Index of each of the distinct pieces; unknown ones are encoded and stored."""
        get = self.place.get
        found = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        for mask, encode in ((simple, self.letters), (~simple, self.others)):
            missing = np.flatnonzero((found < 0) & mask)
            if len(missing):
                new = [pieces[i] for i in missing]
                first = len(self.place)
                self.store(*encode(new))
                self.place.update(zip(new, range(first, first + len(new))))
                self.chars += sum(map(len, new))
                found[missing] = np.arange(first, first + len(new))
        return found

    def store(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.place)
        base = self.ends[first]
        stop = first + len(lengths) + 1
        if stop > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(stop, np.int64)))
        if base + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros(int(base) + len(ids), np.uint32)))
        self.ends[first + 1:stop] = base + np.cumsum(lengths)
        self.flat[base:base + len(ids)] = ids

    def room(self) -> None:
        """Start afresh when full; called between slices, so indices stay valid within one."""
        if len(self.place) > (self.limit or MAX_PIECES) or self.chars > MAX_CHARS:
            self.clear()

    def gather(self, indices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and each piece's number of ids."""
        starts = self.ends[indices]
        lengths = self.ends[indices + 1] - starts
        return self.flat[ragged(starts, lengths)], lengths

    def with_tails(self, vocab: pa.Array, letters: str, lower: bool) -> np.ndarray:
        """Two indices for each string: of the string without a final comma or full stop, and of that mark."""
        plain = pc.match_substring_regex(vocab, pattern=f"^{letters}[.,]?$")
        base = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(vocab) if lower else vocab, ",."), vocab)
        marks = np.zeros(len(vocab), np.int64)
        for mark in ",.":
            ends = pc.and_(plain, pc.ends_with(vocab, mark)).to_numpy(zero_copy_only=False)
            if ends.any():
                marks[ends] = self.indices([mark], np.zeros(1, bool))[0]
        coded = base.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        simple = np.zeros(len(coded.dictionary), bool)
        simple[codes[plain.to_numpy(zero_copy_only=False)]] = True
        return np.stack((self.indices(coded.dictionary.to_pylist(), simple)[codes], marks), axis=1)


class WordCut:
    """For vocabularies that fold case and drop white space: pieces are the words.

    The letters of Latin-1 are letters too: each is one code point that no normal form joins or splits, and its lower
    case is one letter, so such a word is one match of the splitting pattern like an ASCII one.
    """

    letters = "[A-Za-zÀ-ÖØ-öø-ÿ]+"

    def indices(self, texts: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
        words = split_words(texts)
        return cache.with_tails(words.vocab, self.letters, lower=True)[words.codes].ravel(), words.offsets * 2


class SpaceCut:
    """For byte-level vocabularies whose pattern gives one space to the word after it.

    The text is cut before each single space, and a piece keeps that space. A text with a space that has
    white space before it and white space or the end after it is one piece, since the pattern may join such
    spaces.
    """

    letters = " [A-Za-z]+"

    def indices(self, texts: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets, vocab = parts_of(pc.split_pattern(texts, " "))
        whole = self.joined_spaces(codes, offsets, vocab)
        first = offsets[:-1]
        spaced = pc.binary_join_element_wise(" ", vocab, "")
        place = cache.with_tails(spaced, self.letters, lower=False)[codes]
        heads = vocab.take(pa.array(codes[first])).to_pylist()
        rest = np.repeat(whole, np.diff(offsets))
        place[rest] = 0
        for i in np.flatnonzero(whole):
            heads[i] = texts[int(i)].as_py()
        distinct = list(dict.fromkeys(heads))
        known = dict(zip(distinct, cache.indices(distinct, np.zeros(len(distinct), bool))))
        place[first, 0] = [known[h] for h in heads]
        place[first, 1] = 0
        return place.ravel(), offsets * 2

    @staticmethod
    def joined_spaces(codes: np.ndarray, offsets: np.ndarray, vocab: pa.Array) -> np.ndarray:
        """Which texts hold a space inside or at the end of a longer run of white space."""
        flag = lambda pattern: pc.match_substring_regex(vocab, pattern=pattern).to_numpy(zero_copy_only=False)[codes]
        opens, closes = flag(f"^(?:{_SPACE}|$)"), flag(rf"(?:^|{_SPACE})$")
        empty = pc.equal(vocab, "").to_numpy(zero_copy_only=False)[codes]
        head = np.zeros(len(codes), bool)
        head[offsets[:-1]] = True
        closes &= ~(head & empty)  # nothing stands before a text's first space
        bad = np.zeros(len(codes), np.int64)
        bad[1:] = opens[1:] & closes[:-1] & ~head[1:]
        return sum_by_document(bad, offsets) > 0


def encode_texts(texts: pa.Array, cache: PieceCache, cut) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and each text's number of ids."""
    cache.room()
    indices, offsets = cut.indices(texts, cache)
    ids, lengths = cache.gather(indices)
    return ids, sum_by_document(lengths, offsets)


def append_to_each(ids: np.ndarray, counts: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Put ``last`` after each text's ids."""
    out = np.insert(ids, np.cumsum(counts), np.uint32(last)) if len(counts) else ids
    return out, counts + 1


_FOLDING = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_WORDS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def letters_only(path: str, tokenizer):
    """A tokenizer with the same model for texts of lower-case words of letters with one space between them.

    Folding leaves such a text as it is and the splitting pattern cuts it at its spaces, so neither has to run. Where the
    file's steps are not known to do that, the tokenizer itself.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        steps = json.load(file)
    folding, cutting = steps.get("normalizer") or {}, steps.get("pre_tokenizer") or {}
    known = all(n in _FOLDING for n in folding.get("normalizers", [folding] if folding else []))
    split, *rest = cutting.get("pretokenizers") or [{}]
    known &= split.get("type") == "Split" and split.get("pattern") == _WORDS and (split["behavior"], split["invert"]) == ("Removed", True)
    known &= [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
    if not known:
        return tokenizer
    out = Tokenizer(tokenizer.model)
    out.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


_loaded: dict[tuple[str, str], tuple[PieceCache, object]] = {}


def tokenizer_pieces(path: str, kind: str, limit: int | None = None) -> tuple[PieceCache, object]:
    """Cache (of at most ``limit`` pieces) and cut for a ``tokenizers`` file; one of each per worker process.

    ``kind`` is "word" (a byte-pair vocabulary that folds case, drops white space and marks word ends with
    ``</w>``) or "byte" (byte-level, a leading space shown as U+0120). Strings of special tokens inside a text are
    ordinary text.

    Letter-only pieces are encoded many at a time as one text: each is one match of the splitting pattern, so the
    word-end or leading-space marks show where one piece ends and the next begins.
    """
    if (path, kind) not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        marked = np.zeros(max(vocabulary.values()) + 1, bool)
        marked[[i for t, i in vocabulary.items() if (t.endswith("</w>") if kind == "word" else t.startswith("Ġ"))]] = True
        separator = " " if kind == "word" else ""

        def one_by_one(pieces: list[str], by=tokenizer) -> tuple[np.ndarray, np.ndarray]:
            return flat_lists([e.ids for e in by.encode_batch_fast(pieces, add_special_tokens=False)])

        plain = letters_only(path, tokenizer) if kind == "word" else tokenizer

        def together(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            texts = [separator.join(pieces[i:i + JOINED]) for i in range(0, len(pieces), JOINED)]
            ids, _ = one_by_one(texts, plain)
            edges = np.flatnonzero(marked[ids])
            bounds = np.concatenate(([0], edges + 1)) if kind == "word" else np.concatenate((edges, [len(ids)]))
            return ids, np.diff(bounds)

        _loaded[path, kind] = PieceCache(together, one_by_one, limit), {"word": WordCut, "byte": SpaceCut}[kind]()
    _loaded[path, kind][0].limit = limit
    return _loaded[path, kind]


def without_threads() -> None:
    """One task is one core: keep the tokenizers library from starting its own threads."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
