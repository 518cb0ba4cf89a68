"""Cross-tokenizer alignment: which tokens of vocabulary A cover the same bytes as which tokens of vocabulary B.

Tokenizer A is byte-level BPE (``tokenizers`` library) and encodes " " + text; tokenizer B is a sentencepiece BPE
model that adds the space itself. Both encode without special tokens; their strings inside a text are plain text.
A token's bytes are its vocabulary entry: A's entry mapped back through the byte-level alphabet, B's piece in
UTF-8 with U+2581 read as a space and ``<0xHH>`` as the byte HH.

Byte offsets where an A token and a B token both end cut a text into *groups*; a *link* is a pair of an A and a B
token whose byte ranges overlap. Both tokenizations cover the same bytes from start to end, so every link is one
piece between two consecutive token ends of either side, and a group of a A tokens and b B tokens has a + b - 1
links.

Method (identity-map fast path): A's id -> B's id with the same bytes is computed once from the two vocabularies.
Most groups are one A token against one B token with the same bytes; their links are counted per task in a
vector as long as A's vocabulary and summed over tasks, so they never travel as pairs. Only links of the other,
irregular groups go into the shuffle of (A id, B id) pairs. The corpus-wide count of a pair is the identity
vector's entry (for the pair A id, identity B id) plus its count among irregular links. Per document, identity
links are looked up in vocabulary-length vectors, which are bounded and broadcast; irregular links meet the pair
counts in a join.

Defined cases: null or empty text, and texts whose joined A or B token bytes differ from " " + text (B's
normalisation may change spaces or characters), have no tokens: all counts 0 and ``groups_sha256`` ''. Every row is a
document of its own, repeated rows and repeated or null doc_ids included; each has one output row, with its doc_id
as given. Very long texts are encoded whole. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import as_text, binary_rows, parts_of, ragged, slices
from pairsight.llm.pieces import PieceCache, encode_texts, flat_lists, tokenizer_pieces, without_threads
from pairsight.plans.shared import write_once

SLICE_BYTES = 1 << 20   # text encoded in one call of each library; bounds a task's memory beside the longest text
PASS_SCHEMA = ("kind int, row_key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
               "groups_sha256 string, ident binary, a int, b int, mult long")
DOC, PAIR, IDENTITY = 0, 1, 2
KEPT_PIECES = 150_000   # distinct pieces kept for each side; a task also holds both libraries and a slice's arrays


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-in of each byte: the rule of the GPT-2 vocabulary files."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    extra = [b for b in range(256) if b not in kept]
    return {**{chr(b): b for b in kept}, **{chr(256 + i): b for i, b in enumerate(extra)}}


@dataclass
class Vocabularies:
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    identity: np.ndarray        # A id -> B id with the same bytes, or -1

    @property
    def sizes(self) -> tuple[int, int]:
        return len(self.a_bytes), len(self.b_bytes)


def read_vocabularies(a_path: str, b_path: str) -> Vocabularies:
    import sentencepiece
    from tokenizers import Tokenizer

    alphabet = byte_alphabet()
    entries = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
    a_bytes = [b""] * (max(entries.values()) + 1)
    for token, i in entries.items():
        a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    model = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_bytes = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            b_bytes.append(bytes([int(re.fullmatch(r"<0x([0-9A-Fa-f]{2})>", piece)[1], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            b_bytes.append(b"")
        else:
            b_bytes.append(piece.replace("▁", " ").encode())
    place: dict[bytes, int] = {}
    for i, data in enumerate(b_bytes):   # a normal piece before a byte piece of the same bytes
        if data and (data not in place or model.is_byte(place[data])):
            place[data] = i
    identity = np.array([place.get(data, -1) if data else -1 for data in a_bytes], np.int64)
    return Vocabularies(a_bytes, b_bytes, identity)


class _Flat:
    """Bytes of a vocabulary as one array with offsets, for ragged gathers."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.starts[ids], self.lengths[ids])]


class WordPieces:
    """Encodes texts with a sentencepiece BPE model, each distinct word once.

    A text is cut before each single space. If the model leaves text as it is and has no piece with a space after
    another character, no merge crosses such a cut, and a word's ids are those of the word alone, since the model adds
    a space before it. Texts with joined spaces, a space at either end, or the model's own space sign are encoded whole;
    so are all texts for any other model.
    """

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        kept, trained = proto.normalizer_spec, proto.trainer_spec
        # Piece types 1 (normal), 2 (unknown), 3 (control) and 6 (byte) only: user-defined pieces are matched first.
        self.cuts = (trained.model_type == trained.BPE and not trained.treat_whitespace_as_suffix and kept.add_dummy_prefix
                     and kept.escape_whitespaces and not kept.remove_extra_whitespaces and not kept.precompiled_charsmap
                     and not any(p.type not in (1, 2, 3, 6) or "▁" in p.piece.lstrip("▁") for p in proto.pieces))
        self.cache = PieceCache(self.encode, self.encode, KEPT_PIECES)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_lists(self.model.encode(texts, num_threads=1))

    def indices(self, texts: pa.Array, cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
        """For ``encode_texts``: the words of each text, or the text itself if it can't be cut."""
        whole = pc.match_substring_regex(texts, "  |^ | $|▁").to_numpy(zero_copy_only=False) | (not self.cuts)
        codes, offsets, words = parts_of(pc.split_pattern(texts, " "))
        counts = np.diff(offsets)
        used = np.zeros(len(words), bool)
        used[codes[np.repeat(~whole, counts)]] = True
        used, place = np.flatnonzero(used), np.zeros(len(words), np.int64)
        place[used] = cache.indices(words.take(pa.array(used)).to_pylist(), np.zeros(len(used), bool))
        out = place[codes]
        out[np.repeat(whole, counts)] = 0
        if whole.any():
            long = texts.filter(pa.array(whole)).dictionary_encode()
            out[offsets[:-1][whole]] = cache.indices(long.dictionary.to_pylist(), np.zeros(len(long.dictionary), bool))[
                long.indices.to_numpy(zero_copy_only=False)]
        return out, offsets


_loaded: dict[tuple[str, str], tuple] = {}


def _tools(a_path: str, b_path: str):
    """Both tokenizers and the flat vocabularies, once per worker process."""
    if (a_path, b_path) not in _loaded:
        without_threads()
        vocab = read_vocabularies(a_path, b_path)
        flat = _Flat(vocab.a_bytes), _Flat(vocab.b_bytes)
        words = WordPieces(b_path)
        _loaded[a_path, b_path] = (tokenizer_pieces(a_path, "byte", KEPT_PIECES), (words.cache, words), vocab, *flat)
    return _loaded[a_path, b_path]


def _per_doc(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, minlength=n).astype(np.int64) if values is None else \
        np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def align_slice(texts: pa.Array, a_tok, b_tok, vocab: Vocabularies, flat_a: _Flat, flat_b: _Flat) -> dict:
    """Groups and links of a slice of texts (no nulls); see the module docstring."""
    n = len(texts)
    spaced = pc.binary_join_element_wise(" ", texts, "")
    (a_ids, a_counts), (b_ids, b_counts) = encode_texts(spaced, *a_tok), encode_texts(texts, *b_tok)
    a_ids, b_ids = a_ids.astype(np.int64), b_ids.astype(np.int64)
    sizes = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
    a_doc = np.repeat(np.arange(n), a_counts)
    b_doc = np.repeat(np.arange(n), b_counts)
    a_len, b_len = flat_a.lengths[a_ids], flat_b.lengths[b_ids]
    good = ((sizes > 1) & (_per_doc(a_len, a_doc, n) == sizes)
            & (_per_doc(b_len, b_doc, n) == sizes))
    if good.any():
        # Equal totals; now the bytes themselves, over the whole slice at once.
        data = np.frombuffer(spaced.buffers()[2], np.uint8, int(sizes.sum()))
        byte_doc = np.repeat(np.arange(n), sizes)
        keep_a, keep_b, keep_byte = good[a_doc], good[b_doc], good[byte_doc]
        want = data[keep_byte]
        differ_a = flat_a.joined(a_ids[keep_a]) != want
        differ_b = flat_b.joined(b_ids[keep_b]) != want
        good &= _per_doc(None, byte_doc[keep_byte][differ_a | differ_b], n) == 0
    a_ids, a_doc, a_len = a_ids[good[a_doc]], a_doc[good[a_doc]], a_len[good[a_doc]]
    b_ids, b_doc, b_len = b_ids[good[b_doc]], b_doc[good[b_doc]], b_len[good[b_doc]]
    # Token ends as offsets into the slice's texts laid end to end; a text's end is an end of both sides.
    base = np.concatenate(([0], np.cumsum(np.where(good, sizes, 0))))
    a_end = base[a_doc] + _local_ends(a_len, a_doc)
    b_end = base[b_doc] + _local_ends(b_len, b_doc)
    # Each side's ends are sorted and distinct, so one stable merge of the two yields the pieces (distinct ends, one
    # link each), the cuts (ends of both sides) and, by running counts, every token and group index in linear time.
    order = np.argsort(np.concatenate((a_end, b_end)), kind="stable")
    ends, from_a = np.concatenate((a_end, b_end))[order], order < len(a_end)
    first = np.ones(len(ends), bool)
    first[1:] = ends[1:] != ends[:-1]                       # an A end shared with B comes first, then B's copy
    shared = np.zeros(len(ends), bool)
    shared[:-1] = ~first[1:]
    a_before = np.cumsum(from_a) - from_a                   # A ends below this position's end
    b_before = np.arange(len(ends)) - a_before              # B ends below it, where an end comes first
    cuts_before = np.cumsum(shared) - shared - ~first       # cuts below it
    pieces, is_cut = ends[first], shared[first]
    cuts = pieces[is_cut]
    link_a = a_ids[a_before[first]]
    link_b = b_ids[b_before[first]]
    link_group = cuts_before[first]
    a_group, b_group = cuts_before[from_a], cuts_before[~from_a]
    group_a = np.bincount(a_group, minlength=len(cuts))
    group_b = np.bincount(b_group, minlength=len(cuts))
    one_one = (group_a == 1) & (group_b == 1)
    regular = one_one[link_group] & (vocab.identity[link_a] == link_b)
    group_doc = np.searchsorted(base, cuts, side="left") - 1
    link_doc = group_doc[link_group]
    return {
        "good": good, "n_a": _per_doc(None, a_doc, n), "n_b": _per_doc(None, b_doc, n),
        "n_groups": _per_doc(None, group_doc, n), "n_links": _per_doc(None, link_doc, n),
        "groups_sha256": _group_digests(a_ids, b_ids, a_group, b_group, group_doc, n),
        "ident": (link_a[regular], link_doc[regular]),
        "irregular": (link_a[~regular], link_b[~regular], link_doc[~regular]),
    }


def _local_ends(lengths: np.ndarray, owner: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    before = np.maximum.accumulate(np.where(first, total - lengths, 0)) if len(owner) else total
    return total - before


def _group_digests(a_ids, b_ids, a_group, b_group, group_doc, n: int) -> list[str]:
    """sha256 (lowercase hex) of `a1,a2|b1;a3|b2,b3` of each text: decimal ids, A then B within a group, groups in
    order; '' for a text without groups. The texts are laid out as one byte buffer: each id's digits, then its
    separator byte, if any."""
    ids = np.concatenate((a_ids, b_ids))
    group = np.concatenate((a_group, b_group))
    side = np.concatenate((np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)))
    order = np.argsort(group * 2 + side, kind="stable")     # two sorted runs merged; tokens keep their order
    ids, group, side = ids[order], group[order], side[order]
    last_of_side = np.ones(len(ids), bool)
    last_of_side[:-1] = (group[1:] != group[:-1]) | (side[1:] != side[:-1])
    last_of_group = np.ones(len(ids), bool)
    last_of_group[:-1] = group[1:] != group[:-1]
    doc = group_doc[group] if len(group) else np.zeros(0, np.int64)
    last_of_doc = np.ones(len(ids), bool)
    last_of_doc[:-1] = doc[1:] != doc[:-1]
    has_sep = ~(last_of_group & last_of_doc)
    sep = np.where(~last_of_side, ord(","), np.where(side == 0, ord("|"), ord(";"))).astype(np.uint8)
    digits = pa.array(ids.astype(np.int64)).cast(pa.string())
    digit_off = np.frombuffer(digits.buffers()[1], np.int32, len(ids) + 1).astype(np.int64)
    digit_len = np.diff(digit_off)
    out_len = digit_len + has_sep
    out_off = np.concatenate(([0], np.cumsum(out_len)))
    buf = np.empty(int(out_off[-1]), np.uint8)
    if len(ids):
        buf[ragged(out_off[:-1], digit_len)] = np.frombuffer(digits.buffers()[2], np.uint8, int(digit_off[-1]))
        buf[(out_off[:-1] + digit_len)[has_sep]] = sep[has_sep]
    bounds = out_off[np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))]
    raw = memoryview(buf.tobytes())
    return [hashlib.sha256(raw[lo:hi]).hexdigest() if hi > lo else "" for lo, hi in zip(bounds[:-1], bounds[1:])]


def first_pass(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of three kinds: one per document, one per (document, irregular pair), one per (task, A id) of the
    identity vector."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size_a = read_vocabularies(a_path, b_path).sizes[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        a_tok, b_tok, vocab, flat_a, flat_b = _tools(a_path, b_path)
        counted = np.zeros(size_a, np.int64)
        key = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                n = part.num_rows
                found = align_slice(as_text(part.column(1)), a_tok, b_tok, vocab, flat_a, flat_b)
                keys = np.arange(key, key + n, dtype=np.int64)
                key += n
                ident_a, ident_doc = found["ident"]
                counted += np.bincount(ident_a, minlength=size_a)
                # A document's identity links as its A ids, two bytes each (A's ids are below 2^16); links come in
                # text order, so grouped by document already.
                ident = binary_rows(ident_a.astype("<u2"), np.bincount(ident_doc, minlength=n))
                yield _batch(DOC, keys, part.column(0), n_a=found["n_a"], n_b=found["n_b"], n_groups=found["n_groups"],
                             n_links=found["n_links"], groups_sha256=found["groups_sha256"], ident=ident)
                pa_, pb_, pd_ = found["irregular"]
                if len(pa_):
                    code, mult = np.unique((pd_ * vocab.sizes[0] + pa_) * vocab.sizes[1] + pb_, return_counts=True)
                    doc, rest = np.divmod(code, vocab.sizes[0] * vocab.sizes[1])
                    a, b = np.divmod(rest, vocab.sizes[1])
                    yield _batch(PAIR, keys[doc], part.column(0).take(pa.array(doc)), a=a, b=b, mult=mult)
        used = np.flatnonzero(counted)
        if len(used):
            yield _batch(IDENTITY, np.full(len(used), -1, np.int64), pa.nulls(len(used), pa.int64()), a=used, mult=counted[used])

    return narrow.mapInArrow(run, PASS_SCHEMA)


_TYPES = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
          "ident": pa.binary(), "a": pa.int32(), "b": pa.int32(), "mult": pa.int64()}


def _batch(kind: int, keys: np.ndarray, doc_ids: pa.Array, **columns) -> pa.RecordBatch:
    n = len(keys)
    data = {"kind": pa.array(np.full(n, kind, np.int32)), "row_key": pa.array(keys), "doc_id": doc_ids.cast(pa.int64())}
    for name, kind_type in _TYPES.items():
        value = columns.get(name)
        data[name] = pa.nulls(n, kind_type) if value is None else (
            value.cast(kind_type) if isinstance(value, pa.Array) else pa.array(value, kind_type)
            if not isinstance(value, np.ndarray) else pa.array(value.astype(kind_type.to_pandas_dtype())))
    return pa.RecordBatch.from_pydict(data)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (of the groups text,
    '' without tokens). The groups text is hashed inside the task; only its digest is stored."""
    spark = docs.sparkSession
    vocab = read_vocabularies(a_path, b_path)
    size_a, size_b = vocab.sizes
    passed = write_once(first_pass(docs, a_path, b_path), "alignment-pass")
    # Identity links: a vector as long as A's vocabulary, summed over tasks; bounded, so it comes to the driver.
    identity_counts = np.zeros(size_a, np.int64)
    for row in passed.where(F.col("kind") == IDENTITY).groupBy("a").agg(F.sum("mult").alias("c")).collect():
        identity_counts[row["a"]] = row["c"]
    irregular = passed.where(F.col("kind") == PAIR).select("row_key", "a", "b", "mult")
    mapped = np.flatnonzero(identity_counts)
    identity_rows = spark.createDataFrame(
        [(int(a), int(vocab.identity[a]), int(identity_counts[a])) for a in mapped], "a int, b int, c long")
    pair_counts = write_once(irregular.groupBy("a", "b").agg(F.sum("mult").alias("c")).unionByName(identity_rows)
                             .groupBy("a", "b").agg(F.sum("c").alias("count")), "alignment-pairs")
    best = np.zeros(size_b, np.int64)
    for row in pair_counts.groupBy("b").agg(F.max("count").alias("m")).collect():   # at most B's vocabulary
        best[row["b"]] = row["m"]
    full_identity = np.zeros(size_a, np.int64)
    on_identity = pair_counts.join(F.broadcast(spark.createDataFrame(
        [(int(a), int(vocab.identity[a])) for a in np.flatnonzero(vocab.identity >= 0)], "a int, b int")), ["a", "b"])
    for row in on_identity.collect():                                                  # at most A's vocabulary
        full_identity[row["a"]] = row["count"]
    shared = spark.sparkContext.broadcast((full_identity, best, vocab.identity))

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, top, ident_map = shared.value
        for batch in batches:
            blobs = [b or b"" for b in batch.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(blobs), "<u2").astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), [len(b) // 2 for b in blobs])
            counts = full[flat]
            yield pa.RecordBatch.from_pydict({
                "row_key": batch.column(0),
                "id_sum": pa.array(np.bincount(owner, weights=counts, minlength=batch.num_rows).astype(np.int64)),
                "id_best": pa.array(np.bincount(owner, weights=counts == top[ident_map[flat]],
                                                minlength=batch.num_rows).astype(np.int64))})

    documents = passed.where(F.col("kind") == DOC)
    identity_part = documents.select("row_key", "ident").mapInArrow(lookup, "row_key long, id_sum long, id_best long")
    best_rows = spark.createDataFrame([(int(b), int(best[b])) for b in np.flatnonzero(best)], "b int, top long")
    irregular_part = (irregular.join(pair_counts, ["a", "b"]).join(F.broadcast(best_rows), "b")
                      .groupBy("row_key").agg(F.sum(F.col("mult") * F.col("count")).alias("ir_sum"),
                                              F.sum(F.when(F.col("count") == F.col("top"), F.col("mult")).otherwise(0)).alias("ir_best")))
    return (documents.join(identity_part, "row_key").join(irregular_part, "row_key", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links",
                    (F.col("id_best") + F.coalesce("ir_best", F.lit(0))).cast("long").alias("n_best"),
                    (F.col("id_sum") + F.coalesce("ir_sum", F.lit(0))).cast("long").alias("count_sum"), "groups_sha256"))
