"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words of a text, fitted in numpy from confirmed toxic documents (P) and unlabelled text
(U). With class prior p and logistic loss l, the risk is p * mean_P l(+) + max(0, mean_U l(-) - p * mean_P l(-)): the
second term is what negatives would cost, corrected by the prior and kept from going below zero. Labels other than
"confirmed toxic" are used for one thing, the prior (a share, unless it is given).

The fit reads a bounded sample, ``max_positive`` and ``max_unlabelled`` documents chosen by a hash of the id over the whole table.
Scoring reads every whole text, in one pass without a shuffle. Features are whole words by 64-bit hash (A-Z lower-cased, ASCII punctuation
at either end taken off), so no two words share one. The id, language and source are never read as features.

Defined cases: null text is the empty text, scored by the bias alone; null labels are unlabelled; of repeated labels
the largest counts; null ids are scored, and not used to learn; repeated rows are scored each; with no
confirmed document the score is the prior (0 without one); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import as_text, lean, slices, split_words, word_hashes
from pairsight.plans.shared import write_once

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class PuSettings:
    """Bounds of the sample and of the fit."""

    max_positive: int = 8_000
    max_unlabelled: int = 16_000
    max_features: int = 1 << 15
    min_positive_docs: int = 3
    rounds: int = 300
    rate: float = 0.05
    sparsity: float = 3.0      # L1 weight of a word, in standard errors of a chance word's part of the risk's slope
    prior: float | None = None


@dataclass
class ToxicModel:
    """Sorted word hashes with their weights, and the bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Score in [0, 1] for each text."""
        documents, features = distinct_features(texts, self.hashes)
        logit = self.bias + np.bincount(documents, self.weights[features], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, word) entries: documents, and indices into the hashes returned last."""
    words = split_words(texts, lower=True)
    hashes, place = np.unique(word_hashes(pc.ascii_trim(words.vocab, characters=PUNCTUATION)), return_inverse=True)
    entries = np.unique(words.documents * (len(hashes) + 1) + place[words.codes])
    return entries // (len(hashes) + 1), entries % (len(hashes) + 1), hashes


def distinct_features(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) entries for the known word hashes."""
    words = split_words(texts, lower=True)
    if not len(known) or not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = word_hashes(pc.ascii_trim(words.vocab, characters=PUNCTUATION))
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    feature = np.where(known[place] == hashes, place, -1)[words.codes]
    hit = np.flatnonzero(feature >= 0)
    entries = np.unique(words.documents[hit] * len(known) + feature[hit])
    return entries // len(known), entries % len(known)


def sample_texts(docs: DataFrame, labels: DataFrame, learn: Column, settings: PuSettings) -> tuple[DataFrame, float]:
    """(positive, text) rows to fit on, and the share of toxic rows among the labelled ones."""
    confirmed = labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_labelled, n_toxic = confirmed.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    n_docs = docs.where(learn & F.col("doc_id").isNotNull()).count()
    share = lambda most, there: F.lit(min(1.0, most / max(there, 1)))
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # At most about max_positive ids, so a broadcast is bounded whatever the number of labels.
    chosen = confirmed.where((F.col("toxic") == 1) & (draw(1) < share(settings.max_positive, n_toxic))).select("doc_id")
    learnable = docs.where(learn)
    positive = learnable.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")
    unlabelled = learnable.where(F.col("doc_id").isNotNull() & (draw(2) < share(settings.max_unlabelled, n_docs)))
    return positive.unionByName(unlabelled.select(F.lit(False).alias("positive"), "text")), n_toxic / max(n_labelled, 1)


def word_counts(sample: DataFrame) -> DataFrame:
    """(word, n_positive, n_unlabelled): documents of either kind with the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                documents, entries, hashes = distinct_words(as_text(part.column("text")))
                mask = part.column("positive").to_numpy(zero_copy_only=False)[documents]
                count = lambda m: pa.array(np.bincount(entries[m], minlength=len(hashes)), pa.int64())
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array(hashes.view(np.int64)), "p": count(mask), "u": count(~mask)})

    rows = sample.mapInArrow(lean(run), "word long, p long, u long")
    return rows.groupBy("word").agg(F.sum("p").alias("n_positive"), F.sum("u").alias("n_unlabelled"))


def sample_features(sample: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positive flags of the sample's documents, and their distinct (document, feature) entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                documents, features = distinct_features(as_text(part.column("text")), known)
                ends = np.concatenate(([0], np.cumsum(np.bincount(documents, minlength=part.num_rows))))
                yield pa.RecordBatch.from_pydict({
                    "positive": part.column("positive"),
                    "features": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(features, pa.int32()))})

    table = sample.mapInArrow(lean(run), "positive boolean, features array<int>").toArrow()
    positive = table.column("positive").to_numpy()
    lists = table.column("features").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    return positive, np.repeat(np.arange(len(positive)), sizes), lists.flatten().to_numpy().astype(np.int64)


def fit_nnpu(positive: np.ndarray, documents: np.ndarray, features: np.ndarray, n_features: int, prior: float,
             settings: PuSettings) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative PU risk (full-batch Adam).

    The first rounds choose words by a proximal L1 step; as many more refit the chosen ones without it.
    """
    weights, bias = np.zeros(n_features), np.log(prior / (1 - prior))
    moment, scale = np.zeros(n_features + 1), np.zeros(n_features + 1)
    n, n_p = len(positive), max(int(positive.sum()), 1)
    n_u = max(n - int(positive.sum()), 1)
    often = np.bincount(features, minlength=n_features) / max(n, 1)
    chance = settings.sparsity * prior * np.sqrt((often + 1 / n_p) / n_p)   # keeps words that say nothing at zero
    chosen = np.ones(n_features, bool)
    for step in range(1, 2 * settings.rounds + 1):
        if step == settings.rounds + 1:
            chosen, chance = weights != 0, 0.0
        logit = bias + np.bincount(documents, weights[features], minlength=n)
        toxic = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        negative_loss = np.logaddexp(0, logit)              # l(-)
        corrected = negative_loss[~positive].sum() / n_u - prior * negative_loss[positive].sum() / n_p
        # Derivatives of l(+) and l(-) by the logit are toxic - 1 and toxic.
        slope = np.where(positive, prior / n_p * (toxic - 1), 0.0)
        if corrected >= 0:
            slope += np.where(positive, -prior / n_p * toxic, toxic / n_u)
        gradient = np.append(np.bincount(features, slope[documents], minlength=n_features), slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient ** 2
        rate = settings.rate / (np.sqrt(scale / (1 - 0.99 ** step)) + 1e-6)
        move = rate * moment / (1 - 0.9 ** step)
        weights, bias = weights - move[:-1], bias - move[-1]
        weights = np.where(chosen, np.sign(weights) * np.maximum(np.abs(weights) - rate[:-1] * chance, 0), 0.0)
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, settings: PuSettings = PuSettings(), id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on documents and labels whose id satisfies ``learn`` (a condition on ``doc_id``)."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("toxic"))
    sample, share = sample_texts(narrow, marks, learn, settings)
    prior = share if settings.prior is None else settings.prior
    nothing = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    if not 0 < prior < 1:
        return nothing
    sample = write_once(sample, "toxic-sample")
    counts = word_counts(sample).where(F.col("n_positive") >= settings.min_positive_docs)
    ratio = F.col("n_positive") * F.col("n_positive") / (F.col("n_positive") + F.col("n_unlabelled"))
    chosen = counts.orderBy(ratio.desc(), "word").limit(settings.max_features).select("word").toArrow()
    known = np.sort(chosen.column("word").to_numpy().view(np.uint64))
    positive, documents, features = sample_features(sample, known)
    if not positive.any():
        return nothing
    weights, bias = fit_nnpu(positive, documents, features, len(known), prior, settings)
    used = weights != 0
    return ToxicModel(known[used], weights[used], bias)


def score_table(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    narrow = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "score": pa.array(model.scores(as_text(part.column("text"))))})

    return narrow.mapInArrow(lean(run), f"doc_id {narrow.dtypes[0][1]}, score double")


def keep_civil(docs: DataFrame, model: ToxicModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.field(place).name):
                yield part.filter(pa.array(model.scores(as_text(part.column(place))) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
