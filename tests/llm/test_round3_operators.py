"""Ranked search, fingerprints and cross-tokenizer alignment on awkward inputs: nulls, empty and long texts, repeated
rows, other columns with clashing names, empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import re

from llm.cases import AWKWARD, documents, lower, prose

from pairsight.llm import fingerprints, lexical_search, token_alignment


def _vocab(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_search_awkward_rows_against_brute_force(spark):
    docs = documents(spark, AWKWARD + [(20, "same text here"), (21, "text text text here")])
    items = spark.createDataFrame([(0, "same text"), (0, "here"), (1, None), (None, "text"), (2, "STRASSE ÉCOLE ab")],
                                  "item_id long, text string").selectExpr("*", "'z' AS doc_id")
    found = lexical_search.search(docs, items.drop("doc_id").selectExpr("*", "1 AS score"),
                                  lexical_search.SearchSettings(k=3, seed_docs=2))
    got = sorted(tuple(r) for r in found.ranked.collect())
    want = sorted(tuple(r) for r in lexical_search.brute_force(docs, items.drop("doc_id"), k=3).collect())
    assert got == want
    assert {r[0] for r in got} <= {0, 2}                      # null item ids and items without terms have no rows
    assert all(r[2] is not None for r in got)
    empty = lexical_search.search(docs.limit(0), items.drop("doc_id"))
    assert empty.ranked.count() == 0


def test_search_splits_texts_once(spark, monkeypatch):
    """The documents' terms come from one pass of byte operations, equal to the pattern's; repeated ids are pooled."""
    import pyarrow as pa

    draw = random.Random(3)
    texts = ["".join(draw.choice("aZ09_ /:@[`{\x7f~é中\n\x00.-") for _ in range(draw.randrange(40))) for _ in range(500)]
    texts += ["", "a", "", "b"] + [t or "" for _, t in AWKWARD]
    for column, want in ((pa.array(texts), texts), (pa.array(texts).slice(7, 90), texts[7:97]), (pa.array([], pa.string()), [])):
        found, n = lexical_search.split_terms(column)
        terms = [re.findall(lexical_search.TERM, lower(t)) for t in want]
        assert [t.decode() for t in found.to_pylist()] == [t for ts in terms for t in ts]
        assert n.tolist() == [len(ts) for ts in terms]
    rows = list(enumerate(texts)) + [(3, "a b a"), (3, None), (3, "b Z09"), (None, "a a"), (None, "b")]
    pooled = {}
    for doc_id, text in rows:
        pooled.setdefault(doc_id, []).extend(re.findall(lexical_search.TERM, lower(text)))
    held = [ts for ts in pooled.values() if ts]
    total = sum(len(ts) for ts in held)
    items = {0: ["a", "b"], 1: ["z09", "text", "here"], 2: ["中"]}
    want = []
    for item, terms in items.items():
        scores = []
        for doc_id, ts in pooled.items():
            m = 10 + 90 * len(ts) * len(held) // total
            score = sum(int(1000 * math.log((2 * len(held) + 2) / (2 * sum(t in h for h in held) + 1)))
                        * (10 ** 9 * ts.count(t) // (1000 * ts.count(t) + 8 * m)) for t in terms if t in ts)
            if score > 0 and doc_id is not None:
                scores.append((-score, doc_id))
        want += [(item, rank, doc_id, -score) for rank, (score, doc_id) in enumerate(sorted(scores)[:10], 1)]
    items = spark.createDataFrame([(i, " ".join(ts)) for i, ts in items.items()], "item_id long, text string")
    split, regex = [], lexical_search.terms_of
    monkeypatch.setattr(lexical_search, "terms_of", lambda text: split.append(text) or regex(text))
    found = lexical_search.search(documents(spark, rows, 4), items, lexical_search.SearchSettings(seed_docs=20))
    assert sorted(tuple(r) for r in found.ranked.collect()) == sorted(want)
    assert len(split) == 1                                    # the items only; the documents' texts were split this way too


def test_search_scores_common_terms_in_bounded_memory(spark):
    """Documents and items that all share terms: a task holds a bounded run of them, and only the best leave it."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(4)
    n_docs, n_items, terms = 2000, 300, np.arange(24)
    impacts = draw.integers(1, 50, (n_docs, len(terms)))
    lists = {7 * i: np.sort(draw.choice(len(terms), 12, replace=False)) for i in range(n_items)}
    full = np.stack([impacts[:, t].sum(axis=1) for t in lists.values()])
    best = [(7 * i, d, full[i, d]) for i in range(n_items) for d in np.lexsort((np.arange(n_docs), -full[i]))[:3]]
    for chosen in (None, sorted(lists)):
        batch = pa.RecordBatch.from_pydict({
            "doc_id": pa.array(np.arange(n_docs)), "tids": pa.array([terms.tolist()] * n_docs, pa.list_(pa.int32())),
            "impacts": pa.array(impacts.tolist(), pa.list_(pa.int64())), "items": pa.array([chosen] * n_docs, pa.list_(pa.int64()))})
        for k in (None, 3):
            run = lexical_search._scorer(spark, lists, *([k] if k else []))
            found, sizes = [], []
            tracemalloc.start()
            for out in run(iter([batch])):
                sizes.append(out.num_rows)
                found.append(out)
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 100 << 20
            rows = pa.Table.from_batches(found).to_pydict()
            scores = sorted(zip(rows["item_id"], (-s for s in rows["score"]), rows["doc_id"]))
            if k is None:
                assert len(scores) == n_docs * n_items and max(sizes) < n_docs * n_items / 4
                assert all(full[i // 7, d] == -s for i, s, d in scores[::997])
            else:
                assert max(sizes) <= k * n_items
                firsts = {}
                for i, s, d in scores:
                    firsts.setdefault(i, []).append((i, d, -s))
                assert [r for i in sorted(firsts) for r in firsts[i][:3]] == best


def test_fingerprints_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    rows = fingerprints.fingerprint_table(docs).collect()
    assert len(rows) == len(AWKWARD)
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[14][0]["fingerprint"] == by_id[15][0]["fingerprint"] != ""    # equal texts, equal fingerprints
    assert by_id[0][0]["fingerprint"] == "" and by_id[1][0]["fingerprint"] == ""
    assert by_id[0][0]["near_next"] == 0.0 or by_id[0][0]["near_next"] == 1.0
    assert len(by_id[16]) == 2 and by_id[11][0]["n_chars"] == 6000
    assert all(0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0 for r in rows)
    single = fingerprints.fingerprint_table(documents(spark, [(5, "only one text here")], 1)).first()
    assert single["near_next"] == 1.0                          # a single document is its own next
    assert fingerprints.fingerprint_table(docs.limit(0)).count() == 0


def test_fingerprints_store_and_sort_only_what_they_need(spark, monkeypatch):
    """Only names below a document's limit are sorted, repetitive texts whole; the edited fingerprint is stored as its
    difference from the document's and comes back whole."""
    draw = random.Random(5)
    texts = [prose(i, 400, 5000) for i in range(30)] + ["ab" * 2000, "a" * 500, "", "xyz" * 900, "é" + "".join(
        draw.choice("ab") for _ in range(4000))] + [t or "" for _, t in AWKWARD]
    sorted_names, distinct = [], fingerprints._distinct
    monkeypatch.setattr(fingerprints, "_distinct", lambda names, docs: sorted_names.append(len(names)) or distinct(names, docs))
    long = [t for t in texts if len(t) > 1500]
    got = fingerprints.phrase_names(long[:30])
    assert sum(sorted_names) < sum(len(t) for t in long[:30]) // 5
    monkeypatch.undo()
    monkeypatch.setattr(fingerprints, "MARGIN", 10 ** 9)      # every name sorted
    whole = fingerprints.phrase_names(texts)
    monkeypatch.undo()
    assert [a.tolist() for a in fingerprints.phrase_names(texts)] == [a.tolist() for a in whole]
    assert [a.tolist() for a in got] == [a.tolist() for t, a in zip(texts, whole) if len(t) > 1500][:30]
    near = fingerprints.likeness_rows(whole[:-1], whole[1:])
    assert near.tolist() == [fingerprints.likeness(a, b) for a, b in zip(whole, whole[1:])]
    docs = documents(spark, list(enumerate(texts)), 4)
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint(docs).collect()}
    for i, text in enumerate(texts):
        following = texts[i - 1]                              # descending doc_id; the last row's next is the first
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert rows[i]["names"] == whole[i].tolist()
        assert rows[i]["edited_names"] == fingerprints.phrase_names([edited])[0].tolist()
        assert rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert "edited_names" not in fingerprints.WALK_SCHEMA     # stored before: both fingerprints in full


def test_alignment_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    rows = token_alignment.align(docs, _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model")).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        if r["n_a"] == 0:
            assert (r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == (0, 0, 0, 0, 0, "")
        else:
            assert r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] and len(r["groups_sha256"]) == 64
    zero = {r["doc_id"] for r in rows if r["n_a"] == 0}
    assert {0, 1} <= zero                                      # empty and null texts have no tokens
    assert token_alignment.align(docs.limit(0), _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model")).count() == 0


def test_alignment_encodes_each_distinct_word_once():
    import pyarrow as pa

    from pairsight.llm.pieces import encode_texts

    words = token_alignment.WordPieces(_vocab("piece_bpe_32k.model"))
    assert words.cuts
    draw = random.Random(1)
    alphabet = list(" \n\t  aabé中▁\u3000\xa0.,'1🙂\u0301") + ["</s>", "<0x41>"]
    texts = [t or "" for _, t in AWKWARD] + ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(800)]
    ids, counts = encode_texts(pa.array(texts), words.cache, words)
    want = words.model.encode(texts)
    assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    asked, encode = [], words.encode
    words.cache.letters = words.cache.others = lambda pieces: asked.extend(pieces) or encode(pieces)
    encode_texts(pa.array([prose(4, 300).replace("\n", " ").replace("  ", " ").strip(), "some new ones"] * 5), words.cache, words)
    assert len(asked) == len(set(asked)) and {"some", "new"} <= set(asked)


def _byte_level_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, the byte-level BPE convention, written out for the test."""
    kept = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    moved = [b for b in range(256) if b not in kept]
    return {**{chr(b): b for b in kept}, **{chr(256 + k): b for k, b in enumerate(moved)}}


def _brute_alignment(rows, a_path, b_path):
    """Tokens encoded one text at a time, links found by overlapping byte ranges, counters over the corpus."""
    import bisect
    import hashlib
    import re
    from collections import Counter

    import sentencepiece
    from tokenizers import Tokenizer

    a_tok = Tokenizer.from_file(a_path)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=b_path)
    alphabet = _byte_level_alphabet()

    def a_bytes(i):
        return bytes(alphabet[c] for c in a_tok.id_to_token(i))

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        hexed = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode()

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, pairs = [], Counter()
    for doc_id, text in rows:
        target = (" " + (text or "")).encode()
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        ra, rb = ranges([a_bytes(i) for i in a]), ranges([b_bytes(i) for i in b])
        if not text or b"".join(a_bytes(i) for i in a) != target or b"".join(b_bytes(i) for i in b) != target:
            docs.append((doc_id, [], [], [], []))
            continue
        b_starts, b_ends = [s for s, _ in rb], [e for _, e in rb]
        links = [(a[i], b[j]) for i, (s, e) in enumerate(ra)
                 for j in range(bisect.bisect_right(b_ends, s), bisect.bisect_left(b_starts, e))]
        pairs.update(links)
        cuts = sorted({e for _, e in ra} & set(b_ends))
        groups = [([], []) for _ in cuts]
        for side, ids, rng in ((0, a, ra), (1, b, rb)):
            for i, (_, e) in zip(ids, rng):
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        text_ = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        docs.append((doc_id, a, b, groups, links, hashlib.sha256(text_.encode()).hexdigest()))
    best = Counter()
    for (ia, ib), c in pairs.items():
        best[ib] = max(best[ib], c)
    out = []
    for d in docs:
        if not d[1]:
            out.append((d[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        doc_id, a, b, groups, links, digest = d
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(pairs[l] == best[l[1]] for l in links),
                    sum(pairs[l] for l in links), digest))
    return out


def test_alignment_against_brute_force(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table] + AWKWARD
    a_path, b_path = _vocab("byte_bpe_50k.json"), _vocab("piece_bpe_32k.model")
    got = token_alignment.align(documents(spark, rows, partitions=4), a_path, b_path).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(_brute_alignment(rows, a_path, b_path), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want
    assert sum(r[1] > 0 for r in want) > len(table) // 2
