"""Ranked lexical search with LEMP-style norm buckets.

Every document becomes an *impact vector* over the terms that some query holds: impact = w * ((10^9 * tf) div
(1000 * tf + 8 * m)), with w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N) div L. A query is the
0/1 vector of its distinct terms, so its score for a document is the inner product of the two.

Documents are put into buckets by the length of their impact vector, a bucket being a factor of 2^(1/4) of
length. Each document is stored once as a forward-index row (its query terms and impacts), sorted by length, longest
first, within each file, so the row groups of long vectors come first and a filter on length skips the others at
the scan. Work then follows LEMP:

1. The longest buckets, until they hold ``seed_docs`` documents, are scored exactly for every query that shares a
   term with them; the kth score found is a lower bound theta of the query's kth score.
2. Cauchy-Schwarz: a bucket whose upper length edge times |q| is below theta can hold no result and is skipped.
   Inside the other buckets, coordinate bounds: the bucket's largest impact of each query term. Sorted by that
   bound, the query's terms whose bounds sum to less than theta can't lift a document to theta on their own, so
   only documents that hold one of the other (essential) terms are candidates.
3. Candidates are rescored exactly in 64-bit integers from their forward-index rows; the best k per query stay.

Lengths are taken over the query terms' coordinates only: no other coordinate meets a query, and the shorter
vector gives a tighter, still valid, bound. The share of documents rescored is ``SearchResult.scored_share()``.

Defined cases: null text has no terms; a document without terms counts neither in N nor in L and scores nothing;
rows that repeat a doc_id are one document whose terms are pooled; rows with a null doc_id are a document for the
statistics but are never returned; items with a null id or without terms have no rows; rows that repeat an
item_id are one item with the union of their terms; equal scores are ranked by ascending doc_id; only scores
above 0 are ranked, so an item may have fewer than k rows; other columns of the inputs are not read; empty tables
give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import as_text, ragged, slices
from pairsight.plans.shared import write_once

# What a term is, and the constants of the score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEIGHT_SCALE, TF_SCALE, TF_BASE, K1, LENGTH_BASE, LENGTH_SLOPE = 1000, 1_000_000_000, 1000, 8, 10, 90

BANDS_PER_OCTAVE = 4       # a band covers a factor of 2 ** (1 / 4) of vector length
MEETINGS = 500_000         # (document, term, item) triples of one step of numpy work; it bounds a scoring task's memory
MAX_QUERY_TERMS = 5_000_000  # distinct (item, term) rows broadcast at most; beyond, the join shuffles


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    seed_docs: int = 4096       # documents of the longest buckets scored for every query before any pruning
    max_broadcast: int = 20_000_000  # candidate (item, document) pairs broadcast at most; beyond, the join shuffles


@dataclass
class SearchResult:
    ranked: DataFrame           # item_id, rank, doc_id, score
    matched: DataFrame          # (item, document) pairs with a score above 0: what a plain inverted index scores
    scored: DataFrame           # (item, document) pairs scored exactly after pruning: the first buckets' and the candidates

    def scored_share(self) -> float:
        """Share of the (item, document) pairs that share a term and were scored exactly; for reports only."""
        total = self.matched.count()
        return self.scored.count() / total if total else 0.0


def terms_of(text) -> F.Column:
    """Maximal runs of ASCII letters and digits and non-ASCII characters; A-Z lower-cased, null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({TERM})"), 1)


def _sized(frame: DataFrame, limit: int) -> DataFrame:
    """The frame behind a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(frame) if frame.count() <= limit else frame


# Bytes of terms, A-Z lower-cased, and 0 for the others: a term is a maximal run of ASCII letters and digits and of the
# bytes of non-ASCII characters.
_FOLD = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 0 for b in range(256)], np.uint8)


def split_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms (as bytes) of all texts (no nulls), one after the other, and each text's number of terms."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    data = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = data != 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    opens[heads] = inside[heads]                                  # a term ends with its text
    before = np.concatenate(([0], np.cumsum(opens)))
    kept = data[inside]
    starts = np.append(np.flatnonzero(opens[inside]), len(kept)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return found, np.diff(before[offsets])


def term_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, tids, tfs): each row's number of terms, its query terms (places in ``vocabulary``, ascending) and their
    occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast([t.encode() for t in vocabulary])

    def run(batches):
        known = pa.array(shared.value, pa.binary())
        width = max(len(known), 1)
        for batch in batches:
            for part in slices(batch, "text"):
                found, n = split_terms(as_text(part.column(1)))
                owner = np.repeat(np.arange(part.num_rows), n)
                tids = pc.fill_null(pc.index_in(found, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                keys, tfs = np.unique((owner * width + tids)[tids >= 0], return_counts=True)
                ends = np.searchsorted(keys, np.arange(part.num_rows + 1) * width).astype(np.int32)
                lists = lambda values, kind: pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array(n, pa.int64()),
                                                  "tids": lists(keys % width, pa.int32()), "tfs": lists(tfs, pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, tids array<int>, tfs array<long>")


def _pooled(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, n, tids, tfs) of each document (n null for a null id); only rows that repeat a doc_id are shuffled."""
    several = sizes.where("rows > 1")
    if not several.limit(1).count():
        return rows
    repeated = _sized(several.select(F.col("doc_id").alias("_twice")), MAX_QUERY_TERMS)
    same = F.col("doc_id").eqNullSafe(F.col("_twice"))
    entries = rows.join(repeated, same, "left_semi").select("doc_id", F.explode(F.arrays_zip("tids", "tfs")).alias("e"))
    summed = entries.groupBy("doc_id", F.col("e.tids").alias("tids")).agg(F.sum("e.tfs").alias("tfs"))
    lists = summed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("tids", "tfs"))).alias("e"))
    pooled = lists.join(several.select("doc_id", "n"), "doc_id", "left").select(
        "doc_id", "n", F.col("e.tids").alias("tids"), F.col("e.tfs").alias("tfs"))
    return rows.join(repeated, same, "left_anti").unionByName(pooled)


def forward_index(docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(doc_id, edge, tids, impacts): each document's query terms (ids in the sorted query vocabulary, ascending)
    and their impacts, longest vectors first. The texts are split once, in one pass that keeps query terms only."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "doc_id long, edge double, tids array<int>, impacts array<long>")
    wanted = query_terms.select("term").distinct()
    if wanted.count() > MAX_QUERY_TERMS:
        raise ValueError(f"more than {MAX_QUERY_TERMS} distinct query terms")
    vocabulary = sorted(r["term"] for r in wanted.collect())      # bounded: at most MAX_QUERY_TERMS
    counted = write_once(term_counts(docs, vocabulary), "search-terms")
    sizes = counted.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    totals = sizes.agg(F.count_if(F.col("n") > 0).alias("N"), F.sum("n").alias("L")).first()
    n_docs, n_terms = int(totals["N"] or 0), int(totals["L"] or 0)
    if n_docs == 0:
        return none
    documents = _pooled(counted, sizes)
    df = documents.select(F.explode("tids").alias("tid")).groupBy("tid").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT_SCALE)) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    weights = np.zeros(max(len(vocabulary), 1), np.int64)
    for row in df.select("tid", weight.cast("long").alias("w")).collect():      # at most the query vocabulary
        weights[row["tid"]] = row["w"]
    shared = spark.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for batch in batches:
            m = batch.column(1).to_numpy(zero_copy_only=False)
            tids = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            tfs = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            counts = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            impacts = w[tids] * (TF_SCALE * tfs // (TF_BASE * tfs + K1 * np.repeat(m, counts)))
            norm = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, np.cumsum(counts) - counts)) if len(counts) else np.zeros(0)
            band = np.where(norm > 0, np.floor(np.log2(np.where(norm > 0, norm, 1.0)) * BANDS_PER_OCTAVE), -(1 << 20))
            # Upper edge of the bucket, raised by a relative 1e-9 against rounding of the computed length.
            edge = 2.0 ** ((band + 1) / BANDS_PER_OCTAVE) * (1.0 + 1e-9)
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "edge": pa.array(edge, pa.float64()),
                "tids": pa.ListArray.from_arrays(ends, pa.array(tids, pa.int32())),
                "impacts": pa.ListArray.from_arrays(ends, pa.array(impacts, pa.int64()))})

    # 90 * n * N may pass 64 bits on a large corpus; the division is done on 38-digit decimals.
    m = F.lit(LENGTH_BASE) + F.expr(f"CAST(CAST({LENGTH_SLOPE} AS DECIMAL(38, 0)) * n * {n_docs} DIV {n_terms} AS BIGINT)")
    held = documents.where(F.col("doc_id").isNotNull() & (F.size("tids") > 0))
    rows = held.select("doc_id", m.alias("m"), "tids", "tfs").mapInArrow(run, "doc_id long, edge double, tids array<int>, impacts array<long>")
    return write_once(rows.sortWithinPartitions(F.desc("edge")), "search-forward")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term"))
            .where(F.col("item_id").isNotNull()).distinct())


def _item_lists(items: DataFrame, forward_ids: DataFrame) -> dict[int, np.ndarray]:
    """Sorted term ids of each item; bounded by the query vocabulary, so it is broadcast."""
    rows = items.join(F.broadcast(forward_ids), "term").groupBy("item_id").agg(F.array_sort(F.collect_list("tid")).alias("t"))
    return {r["item_id"]: np.array(r["t"], np.int64) for r in rows.collect()}


def _cuts(load: np.ndarray, limit: int):
    """Runs of consecutive rows with a summed load of at most ``limit``, one row at least."""
    ends, first = np.cumsum(load), 0
    while first < len(load):
        stop = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + limit, side="right")))
        yield first, stop
        first = stop


def _scorer(spark, lists: dict[int, np.ndarray], k: int | None = None):
    """mapInArrow function: (doc_id, tids, impacts, items) -> (item_id, doc_id, score) for score > 0.

    ``items`` null means every item: each entry of a document meets the items that hold its term. Otherwise a document's
    (tid, impact) pairs, sorted by tid, are probed for the terms of its items by one binary search each over the keys
    doc * V + tid. Documents are taken in runs of about ``MEETINGS`` meetings or probes, so a task's memory does not
    depend on how many items share a term with how many documents. With ``k``, only the k best documents of each item
    in a run leave the task.
    """
    shared = spark.sparkContext.broadcast(lists)

    def best(item, doc, score):
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        heads = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        rank = np.arange(len(item)) - np.repeat(heads, np.diff(np.append(heads, len(item))))
        return item[rank < k], doc[rank < k], score[rank < k]

    def run(batches):
        lists = shared.value
        every = np.array(sorted(lists), np.int64)
        sizes = np.array([len(lists[i]) for i in every.tolist()], np.int64)
        terms = np.concatenate([lists[i] for i in every.tolist()]) if len(every) else every
        begins = np.cumsum(sizes) - sizes
        width = 1 + int(terms.max()) if len(terms) else 1
        holders = np.repeat(np.arange(len(every)), sizes)[np.argsort(terms, kind="stable")]     # by term
        held = np.bincount(terms, minlength=width)
        heads = np.cumsum(held) - held

        def meetings(owner, tids, values):
            times = held[tids]
            keys = np.repeat(owner, times) * len(every) + holders[ragged(heads[tids], times)]
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], np.repeat(values, times)[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            return keys[first] // len(every), keys[first] % len(every), np.add.reduceat(values, first) if len(first) else values

        def probes(owner, tids, values, pair_doc, pair_item):
            keys = owner * width + tids
            which = np.repeat(np.arange(len(pair_item)), sizes[pair_item])
            probe = pair_doc[which] * width + terms[ragged(begins[pair_item], sizes[pair_item])]
            at = np.minimum(np.searchsorted(keys, probe), max(len(keys) - 1, 0))
            hit = (keys[at] == probe) if len(keys) else np.zeros(len(probe), bool)
            score = np.zeros(len(pair_item), np.int64)
            np.add.at(score, which[hit], values[at[hit]])
            return pair_doc, pair_item, score

        for batch in batches if len(every) else ():
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            counts = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.int64), counts)
            tids = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            known = tids < width
            owner, tids, values = owner[known], tids[known], values[known]
            chosen = batch.column(3)
            n_chosen = pc.fill_null(pc.list_value_length(chosen), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            whole = chosen.is_null().to_numpy(zero_copy_only=False)
            pair_doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), n_chosen)
            pair_item = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(every, pair_item), len(every) - 1)
            found = every[place] == pair_item
            pair_doc, pair_item = pair_doc[found], place[found]
            met = np.bincount(owner, np.where(whole[owner], held[tids], 0), batch.num_rows)
            load = met + np.bincount(pair_doc, sizes[pair_item], batch.num_rows)
            for first, stop in _cuts(load, MEETINGS):
                a, b = np.searchsorted(owner, (first, stop))
                c, d = np.searchsorted(pair_doc, (first, stop))
                all_items = whole[owner[a:b]]
                parts = (meetings(owner[a:b][all_items], tids[a:b][all_items], values[a:b][all_items]),
                         probes(owner[a:b], tids[a:b], values[a:b], pair_doc[c:d], pair_item[c:d]))
                row, item, score = (np.concatenate(x) for x in zip(*parts))
                good = score > 0
                item, doc, score = every[item[good]], doc_ids[row[good]], score[good]
                if k is not None:
                    item, doc, score = best(item, doc, score)
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, pa.int64()), "doc_id": pa.array(doc, pa.int64()),
                                                  "score": pa.array(score, pa.int64())})
    return run


def _exact(forward: DataFrame, pairs: DataFrame | None, run, limit: int) -> DataFrame:
    """(item_id, doc_id, score > 0) of the given pairs (or, without pairs, of every item), in 64-bit integers."""
    if pairs is None:
        rows = forward.select("doc_id", "tids", "impacts", F.lit(None).cast("array<long>").alias("items"))
    else:
        grouped = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))
        grouped = F.broadcast(grouped) if pairs.count() <= limit else grouped
        rows = forward.join(grouped, "doc_id").select("doc_id", "tids", "impacts", "items")
    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, settings: SearchSettings = SearchSettings()) -> SearchResult:
    """The k best documents of every item; see the module docstring for the method and the defined cases."""
    spark = docs.sparkSession
    wanted = write_once(item_terms(items), "search-items")
    forward = forward_index(docs, wanted).where(F.col("doc_id").isNotNull())
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    buckets = sorted(forward.groupBy("edge").count().collect(), reverse=True)
    if not buckets:
        return SearchResult(empty, empty.select("item_id", "doc_id"), empty.select("item_id", "doc_id"))
    ids = spark.createDataFrame(list(enumerate(sorted(r["term"] for r in wanted.select("term").distinct().collect()))),
                                "tid int, term string")
    lists = _item_lists(wanted, ids)
    run, top = _scorer(spark, lists), _scorer(spark, lists, settings.k)
    queries = _sized(wanted.join(F.broadcast(ids), "term").select("item_id", "tid"), MAX_QUERY_TERMS)
    norms = spark.createDataFrame([(i, float(np.sqrt(len(t)))) for i, t in lists.items()], "item_id long, q_norm double")
    # Buckets by length, longest first; a document lies in one, so their counts add up. There are at most a few
    # hundred buckets (4 for each factor of 2 of length), whatever the size of the corpus.
    seed_edge, taken = buckets[0]["edge"], 0
    for bucket in buckets:
        if taken >= settings.seed_docs:
            break
        seed_edge, taken = bucket["edge"], taken + bucket["count"]
    # 1. The first buckets, exactly, for every query that shares a term with them.
    seed = forward.where(F.col("edge") >= seed_edge)
    first = write_once(_best(_exact(seed, None, top, settings.max_broadcast), settings.k), "search-seed")
    theta = (first.groupBy("item_id").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
             .select("item_id", F.when(F.col("found") >= settings.k, F.col("kth")).otherwise(F.lit(1)).alias("theta")))
    limits = norms.join(theta, "item_id", "left").select("item_id", "q_norm", F.coalesce("theta", F.lit(1)).alias("theta"))
    # 2. Cauchy-Schwarz skips buckets; the smallest edge any query needs goes to the scan as a filter.
    lowest = limits.agg(F.min(F.col("theta") / F.col("q_norm"))).first()[0]
    rest = forward.where((F.col("edge") < seed_edge) & (F.col("edge") >= lowest))
    entries = rest.select("doc_id", "edge", F.explode(F.arrays_zip("tids", "impacts")).alias("e")).select(
        "doc_id", "edge", F.col("e.tids").alias("tid"), F.col("e.impacts").alias("impact"))
    peaks = entries.groupBy("edge", "tid").agg(F.max("impact").alias("peak"))
    by_bound = W.partitionBy("item_id", "edge").orderBy("peak", "tid").rowsBetween(W.unboundedPreceding, 0)
    essential = (peaks.join(queries, "tid").join(F.broadcast(limits), "item_id")
                 .where(F.col("q_norm") * F.col("edge") >= F.col("theta"))
                 .withColumn("below", F.sum("peak").over(by_bound))
                 .where(F.col("below") >= F.col("theta")).select("item_id", "edge", "tid"))
    essential = write_once(essential, "search-essential")
    candidates = write_once(entries.join(_sized(essential, settings.max_broadcast), ["edge", "tid"])
                            .select("item_id", "doc_id").distinct(), "search-candidates")
    # 3. Exact rescoring of the candidates, together with the first buckets' best.
    second = _exact(rest, candidates, top, settings.max_broadcast)
    ranked = _best(first.select("item_id", "doc_id", "score").unionByName(second), settings.k)
    everything = _exact(forward, None, run, settings.max_broadcast).select("item_id", "doc_id")
    seeded = _exact(seed, None, run, settings.max_broadcast).select("item_id", "doc_id")
    return SearchResult(ranked.select("item_id", "rank", "doc_id", "score"), everything, seeded.unionByName(candidates))


def brute_force(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Every document scored against every item from the forward index, no pruning: the reference for tests."""
    spark = docs.sparkSession
    wanted = item_terms(items)
    forward = forward_index(docs, wanted).where(F.col("doc_id").isNotNull())
    ids = spark.createDataFrame(list(enumerate(sorted(r["term"] for r in wanted.select("term").distinct().collect()))),
                                "tid int, term string")
    run = _scorer(spark, _item_lists(wanted, ids))
    return _best(_exact(forward, None, run, 0), k).select("item_id", "rank", "doc_id", "score")
