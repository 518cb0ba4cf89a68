"""Exact top-k inner products by block-at-a-time pruning.

Vectors become integers, floor(scale * x). Documents lie in blocks of consecutive ids with a forward index (the block's
vectors) and each dimension's largest and smallest value. A query's bound for a block is the sum over dimensions of the
largest product it can meet there. A query takes blocks in order of its bounds, a few at a time, and stops when
the next bound is below its kth score.

Queries are a stated share of all rows, so the work is a grid: query groups times document groups, both of
bounded size. Each cell finds its best k per query; a window over the cells' lists keeps the best k.

Defined cases: a row with a null id, a null vector, or a null or non-finite component takes no part; rows that
repeat both id and vector count once; a shorter vector has zeros at its end; equal scores are ordered by the
smaller id; other columns are not read; an empty table gives an empty table. Scores beyond 64 bits are an
error (ArithmeticError).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import binary_rows
from pairsight.plans.shared import write_once

QUERY_GROUP = 16_384      # queries of one grid cell
DOC_GROUP = 1 << 18       # documents of one grid cell; the tie-break below needs at most this many
LEAST_GROUP = 2_048       # a smaller group is not worth a task
BLOCK = 256               # documents of a block
STEP = 16                 # blocks a query takes between two looks at its bounds
SLAB = 512                # queries worked on at once
TIE_BITS = 18
LOWEST = np.iinfo(np.int64).min


def quantise(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, codes): 64-bit little-endian integers, for rows that take part."""
    narrow = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            present = pc.and_(ids.is_valid(), lists.is_valid())
            ids, lists = ids.filter(present), lists.filter(present)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            codes = np.floor(scale * flat)
            bad = ~np.isfinite(codes) | (np.abs(codes) >= 2.0 ** 62)
            if (bad & np.isfinite(flat)).any():
                raise ArithmeticError("a component is too large for a 64-bit score")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            good = np.bincount(owner[bad], minlength=len(sizes)) == 0
            data = codes[good[owner]].astype("<i8")
            yield pa.RecordBatch.from_pydict({
                "vec_id": ids.filter(pa.array(good)), "codes": binary_rows(data, sizes[good])})

    return narrow.mapInArrow(run, "vec_id long, codes binary").dropDuplicates(["vec_id", "codes"])


def matrix(codes: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Codes as rows of one int64 matrix, zero-padded."""
    rows = [np.frombuffer(c, "<i8") for c in codes.to_pylist()]
    out = np.zeros((len(rows), max([width or 0, *map(len, rows)])), np.int64)
    for row, values in zip(out, rows):
        row[:len(values)] = values
    return out


def exact_products(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """a @ b.T in integers: in floats where these are exact, else in Python integers."""
    if largest < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int,
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec_id, score) of each query's best k among the documents, any order."""
    width = max(queries.shape[1], docs.shape[1])
    queries, docs = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (queries, docs))
    order = np.argsort(ids, kind="stable")
    ids, docs = ids[order], docs[order]
    largest = int(np.abs(queries).max(initial=0)) * int(np.abs(docs).max(initial=0)) * max(width, 1)
    if largest >= 1 << (62 - TIE_BITS):
        return search_large(query_ids, queries, ids, docs, k)
    n, blocks = len(ids), math.ceil(len(ids) / BLOCK)
    edges = np.arange(blocks) * BLOCK
    high, low = np.maximum.reduceat(docs, edges), np.minimum.reduceat(docs, edges)
    single = largest < 1 << 24
    forward = docs.astype(np.float32 if single else np.float64)
    found = []
    for at in range(0, len(queries), SLAB):
        names, q = query_ids[at:at + SLAB], queries[at:at + SLAB]
        bounds = (exact_products(np.maximum(q, 0), high, largest) + exact_products(np.minimum(q, 0), low, largest))
        turn = np.argsort(-bounds, axis=1, kind="stable")
        sorted_bounds = np.take_along_axis(bounds, turn, axis=1)
        best = np.full((len(q), k), LOWEST, np.int64)   # score << TIE_BITS | (the smaller the index, the larger)
        active, qf = np.arange(len(q)), q.astype(forward.dtype)
        for step in range(0, blocks, STEP):
            kth = best[active].min(axis=1)
            active = active[(kth == LOWEST) | (sorted_bounds[active, step] >= kth >> TIE_BITS)]
            if not len(active):
                break
            chosen = turn[active, step:step + STEP]
            gathered = [best[active]]
            lists = np.full((len(active), chosen.shape[1], k), LOWEST, np.int64)
            by_block = np.argsort(chosen.ravel(), kind="stable")
            values = chosen.ravel()[by_block]
            for members in np.split(by_block, np.flatnonzero(np.diff(values)) + 1):
                block = int(chosen.ravel()[members[0]])
                rows, start = members // chosen.shape[1], block * BLOCK
                stop = min(start + BLOCK, n)
                scores = (qf[active[rows]] @ forward[start:stop].T).astype(np.int64)
                keys = (scores << TIE_BITS) + (DOC_GROUP - 1 - np.arange(start, stop))
                keys[names[active[rows], None] == ids[None, start:stop]] = LOWEST
                if stop - start > k:
                    keys = np.partition(keys, stop - start - k, axis=1)[:, -k:]
                lists[rows, members % chosen.shape[1], :keys.shape[1]] = keys
            gathered.append(lists.reshape(len(active), -1))
            best[active] = np.partition(np.concatenate(gathered, axis=1), -k, axis=1)[:, -k:]
        row, column = np.nonzero(best != LOWEST)
        keys = best[row, column]
        found.append((names[row], ids[DOC_GROUP - 1 - (keys & (DOC_GROUP - 1))], keys >> TIE_BITS))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def search_large(query_ids, queries, ids, docs, k):
    """The same for scores near 64 bits, in Python integers, one query at a time."""
    out = []
    for name, q in zip(query_ids.tolist(), queries):
        scores = docs.astype(object) @ q.astype(object)
        ranked = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != name)[:k]
        if any(not -2 ** 63 <= -s < 2 ** 63 for s, _ in ranked):
            raise ArithmeticError("a score does not fit in 64 bits")
        out += [(name, i, -s) for s, i in ranked]
    return tuple(np.array([r[c] for r in out], np.int64) for c in range(3))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """Each query's k best other rows: query_id, rank, vec_id, score. ``is_query`` is over the column ``vec_id``."""
    spark = vectors.sparkSession
    rows = write_once(quantise(vectors, scale, id_col, vector_col), "topk-codes")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_groups = max(math.ceil(n / (DOC_GROUP // 2)), min(tasks, math.ceil(n / LEAST_GROUP)), 1)
    query_groups = max(math.ceil(n_queries / QUERY_GROUP), 1)
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id", "codes"), F.lit(count)).cast("int")
    left = rows.where(is_query).select(dealt(query_groups).alias("g"), numbers(doc_groups).alias("d"), "vec_id", "codes")
    right = rows.select(numbers(query_groups).alias("g"), dealt(doc_groups).alias("d"), "vec_id", "codes")

    def cell(queries: pa.Table, docs: pa.Table) -> pa.Table:
        ids = lambda t: t.column("vec_id").to_numpy()
        hits = ([np.zeros(0, np.int64)] * 3 if not (queries.num_rows and docs.num_rows) else
                search(ids(queries), matrix(queries.column("codes")), ids(docs), matrix(docs.column("codes")), k))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, hits))))

    hits = left.groupBy("g", "d").cogroup(right.groupBy("g", "d")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(
        W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
