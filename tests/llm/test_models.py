"""Toxicity and language-model scoring: brute force for what is exact, held-out figures for what is learned."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.cases import AWKWARD, documents, lower, prose, words
from pairsight.llm import attention_lm, attention_model, queries, toxicity
from pairsight.llm.arrow_text import split_words

RUDE = ["grubby", "rotten", "vile"]


def toxic_corpus(n=900):
    draw, rows, labels = random.Random(8), [], []
    for i in range(n):
        text, toxic = prose(i, 60, 800), int(draw.random() < 0.2)
        if toxic:
            parts = text.split()
            for _ in range(4):
                parts[draw.randrange(len(parts))] = draw.choice(RUDE).title() + draw.choice([",", ""])
            text = " ".join(parts)
        rows.append((i, text))
        if draw.random() < 0.6:
            labels.append((i, 1, toxic if draw.random() < 0.95 else None))
    return rows, labels


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = toxic_corpus()
    marks = spark.createDataFrame(labels + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + [(5000, ""), (5001, None), (None, "no id")])
    return rows, marks, docs, toxicity.fit(docs, marks, queries.fold("doc_id", 5) != 0)


def test_held_out_toxic_documents_are_found(toxic):
    rows, _, docs, model = toxic
    rude = {i for i, t in rows if any(w in t.lower() for w in RUDE)}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    found = {r.doc_id for r in toxicity.score_table(docs, model).where("score >= 0.5").collect()}
    assert held & rude <= found and len(found - rude) <= 2
    kept = toxicity.keep_civil(docs, model)
    assert kept.schema == docs.schema and kept.count() == docs.count() - docs.join(
        toxicity.score_table(docs, model).where("score >= 0.5"), "doc_id", "left_semi").count()


def test_scores_equal_the_sum_of_word_weights(toxic):
    rows, _, docs, model = toxic
    import xxhash

    weight = dict(zip(model.hashes.tolist(), model.weights))

    def brute(text):
        seen = {xxhash.xxh3_64_intdigest(w.strip(toxicity.PUNCTUATION)) for w in words(lower(text))}
        return 1 / (1 + math.exp(-(model.bias + sum(weight.get(h, 0.0) for h in seen))))

    texts = dict(rows)
    for r in toxicity.score_table(docs, model).where("doc_id < 5000").collect():
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-9
    assert len(toxicity.score_table(docs, model).where("doc_id IS NULL").collect()) == 1


def test_only_learnable_labels_matter(spark, toxic):
    _, marks, docs, model = toxic
    flipped = marks.withColumn("toxic", F.when(queries.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped, queries.fold("doc_id", 5) != 0)
    assert np.allclose(again.weights, model.weights) and again.bias == pytest.approx(model.bias)


def test_nothing_to_learn(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, none, F.lit(True))
    assert [r.score < 0.01 for r in toxicity.score_table(docs, model).collect()] == [True, True]
    assert toxicity.score_table(documents(spark, []), model).count() == 0
    assert toxicity.fit(documents(spark, []), none.limit(0), F.lit(True)).bias < 0


def test_risk_derivative_matches_differences():
    draw = np.random.default_rng(0)
    positive = np.arange(30) < 8
    documents_, features = np.repeat(np.arange(30), 4), draw.integers(0, 6, 120)
    settings = toxicity.PuSettings(rounds=400, sparsity=0.0)
    weights, bias = toxicity.fit_nnpu(positive, documents_, features, 6, 0.3, settings)

    def risk(w, b):
        z = b + np.bincount(documents_, w[features], minlength=30)
        rest = np.logaddexp(0, z)[~positive].mean() - 0.3 * np.logaddexp(0, z)[positive].mean()
        return 0.3 * np.logaddexp(0, -z)[positive].mean() + max(0.0, rest)

    assert risk(weights, bias) < risk(np.zeros(6), np.log(0.3 / 0.7))


LM_ROWS = [(i, t) for i, t in AWKWARD if i is not None] + [(100 + i, prose(i, 80, 60)) for i in range(120)]
SETTINGS = attention_lm.LmSettings(public_tokenizers.path("word_bpe_49k.json"), hot=50, group=40, least_steps=60)


@pytest.fixture(scope="module")
def scored(spark):
    docs = documents(spark, [*LM_ROWS, (None, "no id")])
    return attention_lm.score_table(docs, queries.fold("doc_id", 7) == 2, SETTINGS).collect()


def test_base_scores(scored):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*words(lower(t)), None]
    counts = Counter(w for i, t in LM_ROWS if not held(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)

    def row(i, t):
        known = [counts[w] for w in tokens(t)]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in known)
        return (-1 if i is None else i, held(i), len(known), sum(c > 0 for c in known), total, round(base, 6))

    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored]
    assert sorted(got) == sorted(row(i, t) for i, t in [*LM_ROWS, (None, "no id")])


def test_model_scores_are_probabilities(scored):
    assert all(r.score < 0 and math.isfinite(r.score) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id >= 100]
    vocabulary = 49_408
    subwords = sum(len(prose(r.doc_id - 100, 80, 60)) / 3 for r in held)
    assert sum(r.score for r in held) > -0.7 * subwords * math.log10(vocabulary)


def test_one_document_model_on_nothing(spark):
    held = queries.fold("doc_id", 7) == 2
    assert attention_lm.score_table(documents(spark, []), held, SETTINGS).count() == 0
    only = attention_lm.score_table(documents(spark, [(2, "a b")]), F.lit(True), SETTINGS).first()
    assert (only.n_known, only.train_tokens, only.held_out) == (0, 0, True) and only.base_score == 0.0 and only.score < 0


def tiny_model(spark):
    docs = documents(spark, LM_ROWS)
    return attention_lm.fit(docs, attention_lm.word_counts(docs), len(LM_ROWS), SETTINGS)


def test_next_subword_probabilities_sum_to_one(spark):
    model = tiny_model(spark)
    kinds = attention_lm.classes_of(SETTINGS.path)
    size = len(kinds.classes)
    for before in (size - 1, *np.unique(model.shares.pairs // size)[:5]):
        ids = np.arange(size - 1)
        logs = model.shares.log10(np.full(size - 1, before), ids, kinds.classes)
        mass = np.bincount(kinds.classes[ids], 10.0 ** logs, attention_model.CLASSES)
        assert np.allclose(mass, 1.0, atol=1e-9)


def test_each_target_is_scored_once_with_causal_context(spark):
    model = tiny_model(spark)
    texts = pa.array([prose(1, 90, 60), "", "one two", prose(2, 40, 60)])
    whole = model.log10(split_words(texts, lower=True))
    single = [model.log10(split_words(texts.slice(i, 1), lower=True))[0] for i in range(len(texts))]
    assert np.allclose(whole, single, rtol=1e-5)
    # What comes later does not change what was scored before: class scores of a prefix are those of the longer text.
    draw = np.random.default_rng(3)
    ids = draw.integers(0, 500, 200)
    kinds = attention_lm.classes_of(SETTINGS.path)
    score = lambda n: attention_model.class_log10(
        model.params, kinds.classes[ids[:n]], kinds.letters[ids[:n]], kinds.classes[ids[1:n + 1]], np.array([0, n]), ids[:n],
        model.shares.priors)
    assert np.allclose(score(150)[:100], score(100), rtol=1e-4)


def test_window_scores_equal_the_training_forward_pass():
    params = attention_model.initial(3)
    draw = np.random.default_rng(5)
    n = attention_model.SPAN // 2   # one window: all context is in reach
    classes, letters = draw.integers(0, attention_model.CLASSES, n), draw.integers(0, 27, n)
    targets, priors = draw.integers(0, attention_model.CLASSES, n), draw.normal(size=(n, attention_model.CLASSES)).astype(np.float32)
    fast = attention_model.class_log10(params, classes, letters, targets, np.array([0, n]), np.arange(n), priors)
    pad = lambda v, fill: np.concatenate((v, np.full(attention_model.SPAN - n, fill)))[None]
    wide = np.zeros((1, attention_model.SPAN, attention_model.CLASSES), np.float32)
    wide[0, :n] = priors
    loss = attention_model.step(params, pad(classes, 0), pad(letters, 0), pad(targets, -1), wide).loss
    assert fast.mean() * math.log(10) == pytest.approx(-loss, rel=1e-4)


def test_training_lowers_the_loss():
    draw = np.random.default_rng(1)
    ids = np.cumsum(draw.integers(1, 3, (200, attention_model.SPAN + 1)), axis=1) % 40
    windows = (ids[:, :-1], ids[:, :-1] % 27, ids[:, 1:], ids[:, :-1])
    priors = np.zeros((40, attention_model.CLASSES), np.float32)
    loss = lambda p: attention_model.step(p, *windows[:3], priors[windows[3]]).loss
    start = attention_model.initial()
    assert loss(attention_model.train(start, windows, priors, 150)) < 0.5 * loss(start)


def test_windows_cover_every_training_text_from_start_to_end(spark):
    from tokenizers import Tokenizer

    kinds = attention_lm.classes_of(SETTINGS.path)
    tokenizer = Tokenizer.from_file(SETTINGS.path)
    tokenizer.encode_special_tokens = True
    groups = attention_lm.dealt(attention_lm.text_windows(documents(spark, LM_ROWS), SETTINGS.path), 7).collect()
    parts = [attention_lm.training_windows(g.ids, g.sizes, SETTINGS.path) for g in groups]
    assert len(groups) == 7 and [g.n for g in groups] == [len(p[0]) for p in parts]
    classes, _, targets, inputs = (np.concatenate(x) for x in zip(*parts))
    expected_in, expected_out = Counter(), Counter()
    for _, text in LM_ROWS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        expected_in.update([kinds.end + 1, *ids])
        expected_out.update(kinds.classes[[*ids, kinds.end]].tolist())
    assert Counter(inputs[targets >= 0].tolist()) == expected_in
    assert Counter(targets[targets >= 0].tolist()) == expected_out
    assert (classes[targets < 0] == attention_model.CLASSES).all()


def test_subwords_of_one_class_and_letter_are_told_apart_by_id():
    draw = np.random.default_rng(2)
    ids = draw.integers(0, 2, (300, attention_model.SPAN))
    one = np.ones_like(ids)
    windows = (one, one, 3 + ids, ids)   # the target follows from the id alone
    priors = np.zeros((2, attention_model.CLASSES), np.float32)
    params = attention_model.train(attention_model.initial(size=2), windows, priors, 200)
    n = ids.size
    logs = attention_model.class_log10(params, one.ravel(), one.ravel(), windows[2].ravel(), np.array([0, n]), ids.ravel(), priors)
    assert logs.mean() > math.log10(0.8)   # the class and letter alone: 0.5


def test_gradient_rows_of_ids_match_differences():
    draw = np.random.default_rng(4)
    shape = (2, attention_model.SPAN)
    ids, targets = draw.integers(0, 5, shape), draw.integers(-1, attention_model.CLASSES, shape)
    one, prior = np.ones(shape, np.int64), np.zeros((*shape, attention_model.CLASSES))
    params = {n: v.astype(float) for n, v in attention_model.initial(size=6).items()}
    params["w2"] *= 20
    got = attention_model.step(params, one, one, targets, prior, ids)
    for row, gradient in zip(got.rows, got.row_gradients):
        up, down = ({**params, "id_in": params["id_in"].copy()} for _ in range(2))
        up["id_in"][row, 3] += 1e-5
        down["id_in"][row, 3] -= 1e-5
        slope = (attention_model.step(up, one, one, targets, prior, ids).loss - attention_model.step(down, one, one, targets, prior, ids).loss) / 2e-5
        assert gradient[3] == pytest.approx(slope, rel=2e-3, abs=1e-7)


def test_pairs_that_are_not_broadcast_keep_their_share(spark):
    docs = documents(spark, LM_ROWS)
    held = queries.fold("doc_id", 7) == 2
    few, all_ = ({(r.doc_id, r.n_tokens): r.score for r in attention_lm.score_table(
        docs, held, replace(SETTINGS, rounds=1, least_steps=5, pairs=n)).collect()} for n in (3, 200_000))
    assert few.keys() == all_.keys()
    assert all(few[k] == pytest.approx(all_[k], rel=1e-4, abs=1e-4) for k in few)


def test_buckets_of_rare_words_are_bounded_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(attention_lm, "BUCKET_TOKENS", 200)
    asked, rare_sums = [], attention_lm.rare_sums
    monkeypatch.setattr(attention_lm, "rare_sums", lambda p, v, n: asked.append((n, p)) or rare_sums(p, v, n))
    settings = replace(SETTINGS, rounds=0)
    docs = documents(spark, [(1000 + i, " ".join(f"rare{i}x{j}" for j in range(400))) for i in range(60)])
    attention_lm.score_table(docs, queries.fold("doc_id", 7) == 2, replace(settings, hot=1)).count()
    n, packed = asked[0]
    each = packed.groupBy("kind").agg(F.sum(F.length("words") / 8).alias("n")).agg(F.max("n")).first()[0]
    assert n == 60 * 400 // 200 and each < 400


def test_training_moves_all_weights_as_one_vector():
    """The same weights as Adam written out weight by weight; row maxima by halves are the maxima."""
    M = attention_model
    draw = np.random.default_rng(8)
    for n in (1, 2, 7, 32, 55):
        x = draw.normal(size=(3, 4, n)).astype(np.float32)
        assert (M.highest(x) == x.max(axis=-1, keepdims=True)).all()
    shape = (10, M.SPAN)
    windows = (draw.integers(0, M.CLASSES, shape), draw.integers(0, 27, shape), draw.integers(-1, M.CLASSES, shape), draw.integers(0, 9, shape))
    priors = draw.normal(size=(9, M.CLASSES)).astype(np.float32)
    start = M.initial(size=9)
    before = {n: v.copy() for n, v in start.items()}
    got = M.train(start, windows, priors, 6, batch=10)
    assert all((before[n] == start[n]).all() and got[n].flags.owndata and got[n].dtype == np.float32 for n in start)
    p = {n: v.astype(float) for n, v in before.items()}
    m, s = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    order = np.random.default_rng(1)
    for t in range(1, 7):
        pick = order.permutation(10)
        now = M.step(p, *(w[pick] for w in windows[:3]), priors[windows[3][pick]], windows[3][pick])
        slope = {**now.gradients, "id_in": now.row_gradients}
        for n, g in slope.items():
            at = now.rows if n == "id_in" else slice(None)
            m[n][at] = 0.9 * m[n][at] + 0.1 * g
            s[n][at] = 0.98 * s[n][at] + 0.02 * g * g
            p[n][at] -= 0.01 * min(1.0, 2 * (1 - t / 7)) * (m[n][at] / (1 - 0.9 ** t)) / (np.sqrt(s[n][at] / (1 - 0.98 ** t)) + 1e-7)
    assert all(np.allclose(got[n], p[n], rtol=0, atol=2e-4) for n in p)
