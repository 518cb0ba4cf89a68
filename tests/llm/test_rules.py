"""URL rules, quality rules, chat formatting and top-k search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm.cases import AWKWARD, documents, prose, words
from pairsight.llm import chat, quality, topk, url_filter
from pairsight.llm.queries import PLANTED_TURNS, URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "https://Example.COM/en/x?q#f", "http://www.example.com/en/1",
    "http://www.example.com/enx", "http://a.www.example.com/en/", "http://notexample.com/en/", "http://net/es/", "ftp://x.net/fr/a/b",
    "http://x.net/es", "http://x.net?es/", "http://example.com:80/en/", "http://example.com./en/", "x://a.com/p://b.net/es/",
    "http://x.net//es/", "http://com/\n/x", "http://www.example.com/en/#", "http://EXAMPLE.com#/en/",
]
MORE_RULES = [("block", "org/ab"), ("allow", "org/abc/"), ("block", "a.org/"), ("allow", "a.org/x/y"), ("block", "org/ab")]


def brute_match(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, rule in rules:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail):
            size = (name.count("."), len(tail))
            if best is None or size > best[0]:
                best = (size, rule, verdict)
    return host, path, best and best[1], best[2] if best else "allow"


@pytest.mark.parametrize("rules", [URL_RULES, URL_RULES + MORE_RULES])
def test_url_rules(spark, rules):
    draw = random.Random(4)
    urls = URLS + ["http://" + ".".join(draw.choices(["a", "b", "org", "com"], k=draw.randint(1, 3)))
                   + "".join(draw.choices(["/", "ab", "abc", "c", "x", "y", "/x/y"], k=draw.randint(0, 4))) for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, URLS[6], None), (1, URLS[7], None)],
                                  "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute_match(r.url, rules)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_url_rules_are_checked(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    for bad in (("deny", "com/"), ("block", "/x"), ("block", "com")):
        with pytest.raises(ValueError):
            url_filter.filter_urls(pages, [bad])
    monkeypatch.setattr(url_filter, "MAX_TRIE_BYTES", 10)
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, URL_RULES)


def brute_quality(text):
    w = words(text)
    found = {}
    for n in (3, 5, 6, 7, 8, 9, 10):
        grams = [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]
        count = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(n)}
        found[n] = (len(inside), sum(len(w[i]) for i in inside))
    seen, dup, dup_chars, chars = set(), 0, 0, 0
    for line in (text or "").split("\n"):
        if words(line):
            chars += len(line)
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + len(line)
            seen.add(line)
    total = sum(map(len, w))
    failed = len(w) < 50 or 100 * found[3][0] > 50 * len(w)
    limits = quality.QualityRules().gram_limits
    good = not failed and dup_chars <= 0.2 * chars and all(found[n][1] <= m * total + 1e-9 for n, m in limits.items())
    return (len(w), total, len(re.findall(r"[#*$%&|<>]", text or "")), dup, found[3][0], failed, good)


def test_quality_rules(spark):
    repeated = "the same five words again " * 30
    rows = AWKWARD + [(50 + i, prose(i, 120, 12 + i)) for i in range(40)] + [
        (200, repeated), (201, prose(1, 200) + " " + prose(1, 200)), (202, "\n".join([prose(3, 30)] * 3 + [prose(4, 80)])),
        (203, prose(5, 300, 5000) + "\n" + "\n".join(["| # |"] * 4)), (204, prose(6, 100, 5000) + " " + prose(7, 12) + " x " + prose(7, 12))]
    got = quality.repetition_table(documents(spark, rows)).collect()
    key = lambda i, t: (-1 if i is None else i, t)
    assert sorted(key(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept))
                  for r in got) == sorted(key(i, brute_quality(t)) for i, t in rows)
    docs = documents(spark, rows)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in rows if brute_quality(t)[-1])
    assert quality.repetition_table(documents(spark, [])).count() == quality.keep_good(documents(spark, [])).count() == 0


TURNS = PLANTED_TURNS + [
    (1, 2, "assistant", "b\\n<\\s>"), (1, 0, "system", ""), (1, 1, "user", None), (2, 0, None, "x [/INST]<s>"), (3, 0, "assistant", "only é 中"),
    (3, 0, "assistant", "only é 中"), (None, 0, "user", "[\\INST][\\\\/INST]"), (None, 1, "assistant", "<s></s><\\\\/s>"), (4, None, "user", "t"),
    (4, 1, " [/INST]", "role with a control string"), (5, 0, "user", "long " * 5000), (5, 1, "assistant", "<s>" * 3000),
]


def test_chat_round_trip(spark):
    frame = spark.createDataFrame([(*t, 0, "z") for t in TURNS], "conv_id long, turn long, role string, text string, "
                                  "n_turns int, formatted string")
    formatted = chat.format_conversations(frame)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    shape = {r.conv_id: r for r in formatted.collect()}
    none_first = lambda x: (x is not None, x or 0 if not isinstance(x, str) else x)
    for conv in {t[0] for t in TURNS}:
        turns = sorted((t for t in TURNS if t[0] == conv), key=lambda t: tuple(map(none_first, t[1:2])) + (t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in back[conv].turns] == [(t[2] or "", t[3] or "") for t in turns]
        assert back[conv].loss_text == "".join(t[3] or "" for t in turns if t[2] == "assistant")
        text = shape[conv].formatted
        assert text.count("</s>") == text.count("<s>[INST] ") == len(turns) == shape[conv].n_turns
        assert "".join(re.findall(r"<s>|</s>|\[INST\]|\[/INST\]", text)) == "<s>[INST][/INST]</s>" * len(turns)
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_chat_conversations_across_batches(spark):
    rows = [(i % 7, t, "assistant" if t % 2 else "user", f"text {i} {t}") for i in range(7) for t in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        back = chat.read_back(chat.format_conversations(frame)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.conv_id: [t["text"] for t in r.turns] for r in back} == {
        c: [f"text {c} {t}" for t in range(40)] for c in range(7)}


def test_chat_digests(spark, monkeypatch):
    from pairsight.llm import queries

    frame = spark.createDataFrame([t for t in TURNS if t[0] != -7], queries.SCHEMAS["conversations"])
    monkeypatch.setattr(queries, "load", lambda s, d, n: frame)
    planted = next(r for r in queries.op9_chat(spark, "").collect() if r.conv_id == -7)
    text = queries.PLANTED_TEXT
    assert planted.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (planted.n_turns, planted.loss_chars, planted.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def brute_top(rows, k, every):
    codes = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, a in codes:
        if q % every == 0:
            ranked = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in codes if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e2, 1e5])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "STEP", 2)
    monkeypatch.setattr(topk, "LEAST_GROUP", 64)
    draw = random.Random(3)
    vector = lambda: [draw.gauss(0, scale) for _ in range(6)]
    same = vector()
    rows = [(i, vector()) for i in range(200)] + [(i, same) for i in range(200, 260)] + [
        (260, None), (261, [1.0, None, 2.0]), (262, [float("nan")] * 6), (263, [float("inf")] * 6), (None, vector()), (264, []),
        (265, [0.5, 0.25]), (201, same), (201, same)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "0 AS score", "'c' AS codes", "1 AS g")
    got = topk.top_k(frame, F.col("vec_id") % 10 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute_top(rows, 5, 10)


def test_top_k_of_little(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(frame, F.col("vec_id") % 2 == 0).count() == 0
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 2 == 0).count() == 0


def test_blocks_are_pruned(monkeypatch):
    import numpy as np

    seen = []
    real = np.partition
    monkeypatch.setattr(topk.np, "partition", lambda a, *b, **c: seen.append(a.shape) or real(a, *b, **c))
    ids = np.arange(64 * 256)
    docs = np.repeat(np.arange(64)[:, None] * 4, 256, axis=0) + np.zeros((1, 4), np.int64)
    names, found, scores = topk.search(np.array([-1]), np.ones((1, 4), np.int64), ids, docs, 5)
    assert sorted(found) == list(range(63 * 256, 63 * 256 + 5)) and set(scores) == {4 * 63 * 4}
    assert len(seen) < 64 // 2
