"""Token files, byte-level BPE and packing against the tokenizer libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.cases import AWKWARD, documents, prose
from pairsight.llm import byte_bpe, packing, pieces, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS = AWKWARD + [(100 + i, prose(i, 400)) for i in range(30)]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def tiktoken_encoder():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name, kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_give_the_ids_of_whole_texts(name, kind):
    draw = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "é", "1", "23", "'s", ".", ",", "!!", "ß", "的", "\x1c", "\u2003",
             "ABC", "\r\n", "the", "\x85", "Σ"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in ROWS]
    encode = library(name)
    cache, cut = pieces.tokenizer_pieces(public_tokenizers.path(name), kind)
    ids, counts = pieces.encode_texts(pa.array(texts), cache, cut)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]


def test_latin_words_are_encoded_together(monkeypatch):
    """Words of Latin-1 letters take the way of ASCII words; the ids stay the library's, whatever stands beside them."""
    draw = random.Random(6)
    name, letters = "word_bpe_49k.json", [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    latin = ["".join(draw.choices(letters + ["a", "K"], k=draw.randint(1, 9))) + draw.choice(["", ",", "."]) for _ in range(2000)]
    odd = ["".join(draw.choices(letters + ["\u0301", "\u0130", "\u017f", "\xaa", "\xb5", "\xba", "\xd7", "\xf7", "\xad", "\u03a3", "1"], k=5))
           for _ in range(500)]
    texts = [" ".join(draw.choices(latin + odd, k=draw.randint(0, 9))) for _ in range(800)] + [" ".join(latin)]
    cache, cut = pieces.tokenizer_pieces(public_tokenizers.path(name), "word")
    cache.clear()
    alone, others = [], cache.others
    monkeypatch.setattr(cache, "others", lambda new: alone.extend(new) or others(new))
    ids, counts = pieces.encode_texts(pa.array(texts), cache, cut)
    encode = library(name)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [encode(t) for t in texts]
    assert not set(alone) & set(latin)


def test_piece_cache_starts_afresh_when_full(monkeypatch):
    monkeypatch.setattr(pieces, "MAX_PIECES", 3)
    cache = pieces.PieceCache(*[lambda new: (np.array([len(p) for p in new], np.uint32), np.ones(len(new), np.int64))] * 2)
    for texts in (["aa bbb"], ["c dd eee f"], ["aa"]):
        ids, _ = pieces.encode_texts(pa.array(texts), cache, pieces.WordCut())
        assert ids.tolist() == [len(w) for w in texts[0].split()]


def test_token_files(spark, tmp_path):
    target = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, ROWS), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    rows = token_files.with_starts(token_files.read_token_files(spark, target)).orderBy("start").collect()
    encode, at = library("word_bpe_49k.json"), 0
    want = defaultdict(list)
    for i, t in ROWS:
        want[i].append(encode(t) + [2])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i))
    for r in rows:
        assert r.ids in want[r.doc_id] and (r.start, r.n_tokens) == (at, len(r.ids))
        at += len(r.ids)
    sums = token_files.id_checksums(token_files.read_token_files(spark, target).select("doc_id", "ids")).collect()
    assert sorted((r.doc_id or -1, r.ids_crc32) for r in sums) == sorted(
        (i or -1, zlib.crc32(np.array(ids, "<u4").tobytes())) for i, lists in want.items() for ids in lists)


def test_token_files_of_nothing(spark, tmp_path):
    target = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, []), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert token_files.with_starts(token_files.read_token_files(spark, target)).count() == 0


def test_metadata_reads_leave_the_ids_alone(spark, tmp_path):
    target = str(tmp_path / "tokens")
    token_files.write_token_files(documents(spark, ROWS), target, public_tokenizers.path("word_bpe_49k.json"))
    plan = token_files.read_token_files(spark, target).where("doc_id = 3").select("n_tokens")
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in text and "ids:array" not in text.split("Physical Plan")[1]


def test_byte_bpe_equals_tiktoken(spark):
    reference = tiktoken_encoder()
    rows = byte_bpe.decode(byte_bpe.encode(documents(spark, ROWS), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    want = sorted((i or -1, (t or "").encode(), reference.encode_ordinary(t or "")) for i, t in ROWS)
    assert sorted((r.doc_id or -1, bytes(r.decoded), np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == want
    both = byte_bpe.encode(documents(spark, ROWS), RANKS, public_tokenizers.PATTERN, decode=True).collect()
    assert sorted((r.doc_id or -1, bytes(r.decoded), [int(x) for x in r.ids_text.split(",") if x]) for r in both) == want
    assert byte_bpe.encode(documents(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_long_and_batched_trees_agree():
    bpe, _ = byte_bpe.loaded(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(2)
    some = [bytes(draw.choices(b"abcdeth \xc3\xa9", k=draw.randint(2, 64))) for _ in range(500)]
    for width in (2, 4, 8, 16, 32, 64):
        chosen = [w for w in some if width // 2 < len(w) <= width]
        if chosen:
            ids, counts = bpe.merge_many(chosen, width)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.merge_long(w) for w in chosen]


def check_packing(rows, want, limits):
    ids_of, by_sequence = defaultdict(dict), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        ids_of[r.doc_id, r.doc_tokens][r.start] = ids
        by_sequence[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    padding = total = 0
    for members in by_sequence.values():
        at = 0
        for offset, length, _ in sorted(members):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(members) <= limits.segments and sum(m[2] for m in members) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
        total += at
    assert total == sum(len(w) for lists in want.values() for w in lists)
    return padding / max(total, 1)


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(tokens=256, segments=3, loss_tokens=200, block=16)])
def test_packing_covers_every_id(spark, limits):
    encode, want = library("byte_bpe_50k.json"), defaultdict(list)
    unique = [(i, t) for i, t in ROWS if i not in (None, 16)] + [(500 + i, prose(i, 10 + 37 * i)) for i in range(60)]
    for i, t in unique:
        want[i].append(encode(t) + [1])
    frame = packing.pack_documents(documents(spark, unique), public_tokenizers.path("byte_bpe_50k.json"), limits=limits)
    rows = frame.collect()
    padding = check_packing(rows, want, limits)
    assert padding < 0.01 or limits.loss_tokens < limits.tokens
    pieces_of = defaultdict(list)
    for r in rows:
        pieces_of[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i, found in pieces_of.items():
        joined = [t for _, ids, _ in sorted(found) for t in ids]
        assert joined == want[i][0] and {n for *_, n in found} == {len(joined)}
    assert sorted((r.sequence_id, r.offset, r.doc_id) for r in rows) == sorted(
        (r.sequence_id, r.offset, r.doc_id) for r in frame.collect())


def test_packing_repeats_nulls_and_nothing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack_documents(documents(spark, [(None, "no id"), (16, "twice"), (16, "twice"), (1, None)]), path).collect()
    encode = library("byte_bpe_50k.json")
    assert sum(r.length for r in rows) == len(encode("no id")) + 2 * len(encode("twice")) + 4
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_segments_respect_unscored_prompts():
    limits = packing.Limits(tokens=100, segments=4, loss_tokens=40, block=8)
    draw = random.Random(1)
    packer, done, total = packing.Packer(limits), [], 0
    for i in range(200):
        size = draw.randint(1, 60)
        segment = packing.Segment(i, 0, size, draw.randint(0, size))
        total += size
        done += packer.add(segment)
        if len(packer.open) >= limits.block:
            done += packer.flush(last=False)
    done += packer.flush(last=True)
    assert sum(s.length for b in done for s in b) == total
    for b in done:
        assert sum(s.length for s in b) <= 100 and len(b) <= 4 and sum(s.loss for s in b) <= 40


def test_contract_columns(spark, monkeypatch):
    from pairsight.llm import queries

    monkeypatch.setattr(queries, "load", lambda s, d, n: documents(s, ROWS).select("doc_id", "text", "lang", "source", "n_chars"))
    reference = tiktoken_encoder()
    rows = queries.op3_byte_bpe(spark, "").where(F.col("doc_id") >= 100).collect()
    texts = dict(ROWS)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(ids)
    tokens = queries.op1_token_files(spark, "").orderBy("start").collect()
    assert tokens[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(tokens, tokens[1:]))
