"""Near-duplicate components by a chosen-path set similarity join.

A document's set is its distinct shingles of ``words`` lower-cased words (the whole sequence, if it has fewer). Documents
with equal sets are one to begin with. Each distinct set gets ``minima`` coordinates: the least value of its shingles under
as many hash functions. A tree branches a node's documents by a few of these coordinates, picked by a hash of the node, with
1 / similarity of them expected and one at least: documents that share the value at a picked coordinate share the child.

- A node of at most ``node_size`` documents is compared exhaustively.
- A larger node is dealt into cells of that size by a hash of the document; each cell is compared, and the
  node branches on. No task ever holds more than a cell.
- A node all of whose documents are in one component by now has nothing to add and goes. That, and the fresh cells of
  every level, is what ends the recursion in a large group of near copies: it becomes one component at once.
- A large node with few documents outside its main component is compared in cells that hold those few and a part of the rest:
  every pair across components is looked at, so it ends there.

Comparing means: estimate by four bits of each coordinate, with a margin of four standard errors, then confirm on the
full sets of the texts. Only texts with a likely link are read for that: their ids are broadcast up to a checked number, and
beyond it the texts are shuffled. Trees are independent; ``trees`` of them miss a pair at the threshold with a chance of about 0.11 ** trees.
Links are a spanning set within a compared group, so a group of copies never yields all its pairs.

Defined cases: null and empty texts, and texts without words, have an empty set and link with nothing; a
null id gets null for component and kept; rows that repeat an id are one vertex that has all their sets;
other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import as_text, binary_rows, lean, mix64, ragged, slices, split_words, word_hashes
from pairsight.llm.components import components
from pairsight.plans.shared import write_once

FACTOR = np.uint64(0x9E3779B97F4A7C15)
PICK = 1 << 20
MAX_BROADCAST_IDS = 2_000_000   # 64-bit ids; about 64 MB on an executor


@dataclass(frozen=True)
class NearDupSettings:
    """``percent``: link when 100 * intersection >= percent * union."""

    percent: int = 80
    words: int = 5
    minima: int = 64
    trees: int = 8
    first_trees: int = 2       # trees of the first level; the others start once its links are known
    node_size: int = 2048
    margin: float = 4.0        # standard errors below the threshold up to which an estimate is still confirmed

    @property
    def least_equal(self) -> int:
        """Equal four-bit values from which on two documents are confirmed."""
        p = self.percent / 100 + (1 - self.percent / 100) / 16
        return int(self.minima * p - self.margin * (self.minima * p * (1 - p)) ** 0.5)

    @property
    def share(self) -> float:
        """Expected share of the coordinates that a node picks."""
        return 100 / self.percent / self.minima


# --- Sets and sketches, inside tasks -----------------------------------------------------------

def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after the other, and their numbers."""
    words = split_words(texts, lower=True)
    counts, size = words.counts, len(words.codes)
    windows = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    starts = ragged(words.offsets[:-1], windows)
    lengths = np.repeat(np.minimum(counts, n), windows)
    hashes = word_hashes(words.vocab)[words.codes] if size else np.zeros(0, np.uint64)
    value = lengths.astype(np.uint64)
    for k in range(n):
        inside = lengths > k
        value = np.where(inside, value * FACTOR + hashes[np.where(inside, starts + k, 0)], value) if size else value
    value = mix64(value)
    documents = np.repeat(np.arange(len(counts)), windows)
    order = np.lexsort((value, documents))
    value = value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (documents[1:] != documents[:-1])
    return value[fresh], np.bincount(documents[fresh], minlength=len(counts))


def sliced_sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`shingle_sets` of a table's texts, made slice by slice: making a set takes about ten times what it holds."""
    made = [shingle_sets(as_text(part.column("text")), n) for batch in table.to_batches() for part in slices(batch, "text")]
    values, counts = zip(*made) if made else ([np.zeros(0, np.uint64)], [np.zeros(0, np.int64)])
    return np.concatenate(values), np.concatenate(counts)


def minima_of(values: np.ndarray, counts: np.ndarray, number: int) -> np.ndarray:
    """``number`` minwise values of each non-empty set, as rows of 32-bit integers (zeros for an empty one)."""
    out = np.zeros((len(counts), number), np.uint32)
    filled = counts > 0
    if not filled.any():
        return out
    starts = (np.cumsum(counts) - counts)[filled]
    upper = (values >> np.uint64(32)).astype(np.uint32)
    seeds = mix64(np.arange(1, 2 * number + 1, dtype=np.uint64)).astype(np.uint32)
    for c in range(number):
        hashed = (upper ^ seeds[2 * c]) * (seeds[2 * c + 1] | np.uint32(1))
        out[filled, c] = np.minimum.reduceat(hashed ^ (hashed >> np.uint32(15)), starts)
    return out


def low_bits(minima: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two to a byte."""
    bits = ((minima >> np.uint32(7)) & np.uint32(15)).astype(np.uint8)
    return bits[:, ::2] | bits[:, 1::2] << 4


def sketch(docs: DataFrame, settings: NearDupSettings) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, minima, bits): a 128-bit key of the set, its minima and their low bits, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part in slices(batch, "text"):
                values, counts = shingle_sets(as_text(part.column("text")), settings.words)
                ends = np.cumsum(counts)
                raw = memoryview(values).cast("B") if len(values) else b""
                keys = b"".join(xxhash.xxh3_128_digest(raw[8 * a:8 * b]) for a, b in zip(ends - counts, ends))
                keys = np.frombuffer(keys, "<i8").reshape(-1, 2)
                minima = minima_of(values, counts, settings.minima)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_shingles": pa.array(counts, pa.int64()),
                    "k1": pa.array(keys[:, 0]), "k2": pa.array(keys[:, 1]),
                    "minima": binary_rows(minima.ravel(), np.full(len(counts), settings.minima)),
                    "bits": binary_rows(low_bits(minima).ravel(), np.full(len(counts), settings.minima // 2))})

    return docs.mapInArrow(lean(run), "doc_id long, n_shingles long, k1 long, k2 long, minima binary, bits binary")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from rows sorted by ``key``, with the bounds of the groups."""
    waiting: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([waiting, table]) if waiting is not None else table
        keys = table.column(key).to_numpy()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        if len(first) > 1:
            yield table.slice(0, int(first[-1])), first
        waiting = table.slice(int(first[-1]))
    if waiting is not None:
        yield waiting, np.array([0, len(waiting)])


def alike(values: np.ndarray, groups: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Sets of documents joined by likely links across groups."""
    size = len(values)
    near = np.zeros((size, size), bool)
    for i in range(size - 1):
        near[i, i + 1:] = ((values[i + 1:] == values[i]).sum(axis=1) >= least) & (groups[i + 1:] != groups[i])
    near |= near.T
    label = np.arange(size, dtype=np.int32)
    while True:
        lower = np.minimum(label, np.where(near, label[None, :], np.int32(size)).min(axis=1))
        lower = np.minimum(lower, lower[lower])
        if (lower == label).all():
            break
        label = lower
    for value in np.unique(label):
        members = np.flatnonzero(label == value)
        if len(members) > 1:
            yield members


def likely_clusters(cells: DataFrame, settings: NearDupSettings) -> DataFrame:
    """(cluster, docs, groups) of the documents of a cell that may have links across components."""
    least = settings.least_equal

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(batches, "cell"):
            docs, groups = table.column("doc").to_numpy(), table.column("component").to_numpy()
            packed = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(len(docs), -1)
            values = np.concatenate((packed & 15, packed >> 4), axis=1)
            bounds = np.append(first, len(docs)) if first[-1] != len(docs) else first
            found = []
            pairs = np.diff(bounds) == 2
            a = bounds[:-1][pairs]
            close = ((values[a] == values[a + 1]).sum(axis=1) >= least) & (groups[a] != groups[a + 1])
            found += [np.array([i, i + 1]) for i in a[close]]
            for start, stop in zip(bounds[:-1][~pairs], bounds[1:][~pairs]):
                found += [start + m for m in alike(values[start:stop], groups[start:stop], least)]
            found = [m[np.argsort(docs[m], kind="stable")] for m in found]
            names = [int(np.bitwise_xor.reduce(mix64(mix64(docs[m].view(np.uint64)) + np.uint64(len(m)))).view(np.int64))
                     for m in found]
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(names, pa.int64()), "docs": pa.array([docs[m] for m in found], pa.list_(pa.int64())),
                "groups": pa.array([groups[m] for m in found], pa.list_(pa.int64()))})

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(lean(run), "cluster long, docs array<long>, groups array<long>")


def confirm(values: np.ndarray, counts: np.ndarray, docs: np.ndarray, groups: np.ndarray, percent: int,
            ) -> list[tuple[int, int]]:
    """Confirmed links between components: enough to join all that the full sets join."""
    names, group = np.unique(groups, return_inverse=True)
    shingles, place = np.unique(values, return_inverse=True)
    ends = np.cumsum(counts)
    starts, owner = ends - counts, np.repeat(np.arange(len(counts)), counts)
    links = []
    for i in range(len(docs)):
        others = group != group[i]
        if not others.any():
            break
        mark = np.zeros(len(shingles), bool)
        mark[place[starts[i]:ends[i]]] = True
        shared = np.bincount(owner, mark[place], minlength=len(counts)).astype(np.int64)
        linked = np.flatnonzero(others & (shared > 0) & (100 * shared >= percent * (counts + counts[i] - shared)))
        for j in linked:
            if group[j] != group[i]:
                links.append((int(groups[i]), int(groups[j])))
                group[group == group[j]] = group[i]
    return links


def confirmed_links(clusters: DataFrame, docs: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Links (a, b) between components, confirmed on the full sets of the whole texts."""
    members = clusters.select("cluster", F.explode(F.arrays_zip("docs", "groups")).alias("m")).select(
        "cluster", F.col("m.docs").alias("doc_id"), F.col("m.groups").alias("component"))
    ids = members.select("doc_id").distinct()
    if ids.count() <= MAX_BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    dealt = members.join(docs, "doc_id").repartition("cluster").sortWithinPartitions("cluster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in runs(batches, "cluster"):
            bounds = np.append(first, len(table)) if first[-1] != len(table) else first
            ids, groups = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
            links = []
            values, counts = sliced_sets(table, settings.words)
            ends = np.append(0, np.cumsum(counts))
            for a, b in zip(bounds[:-1], bounds[1:]):
                links += confirm(values[ends[a]:ends[b]], counts[a:b], ids[a:b], groups[a:b], settings.percent)
            columns = list(zip(*links)) or [[], []]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in zip("ab", columns)})

    return dealt.select("cluster", "doc_id", "component", "text").mapInArrow(lean(run), "a long, b long")


# --- The tree, level by level ------------------------------------------------------------------

def value_at(coordinate: Column) -> Column:
    return F.substring(F.col("minima"), coordinate * 4 + 1, F.lit(4))


def roots(reps: DataFrame, trees: range, settings: NearDupSettings) -> DataFrame:
    """Children of the root of each tree: (node, doc)."""
    children = []
    for tree in trees:
        draw = Random(tree)
        picked = [c for c in range(settings.minima) if draw.random() < settings.share] or [draw.randrange(settings.minima)]
        children += [F.xxhash64(F.lit(tree), F.lit(c), value_at(F.lit(c))) for c in picked]
    return reps.select(F.explode(F.array(*children)).alias("node"), "doc")


def branch(members: DataFrame, reps: DataFrame, settings: NearDupSettings) -> DataFrame:
    """Children of the given (node, doc) rows."""
    picked = F.filter(F.sequence(F.lit(0), F.lit(settings.minima - 1)), lambda c: F.pmod(
        F.xxhash64("node", c), F.lit(PICK)) < F.lit(int(settings.share * PICK)))
    one = F.array(F.pmod(F.xxhash64("node"), F.lit(settings.minima)).cast("int"))
    chosen = F.when(F.size(picked) > 0, picked).otherwise(one)
    child = F.transform(chosen, lambda c: F.xxhash64("node", c, value_at(c)))
    return members.join(reps, "doc").select(F.explode(child).alias("node"), "doc")


def cells_of(rows: DataFrame, size: int, level: int) -> DataFrame:
    """(cell, doc, component): how a level's documents meet. ``rows``: node, doc, component, n, main, main_n."""
    whole, few = F.col("n") <= size, F.col("n") - F.col("main_n") <= size // 2
    dealt = F.pmod(F.xxhash64("doc", F.lit(level)), F.ceil(F.col("n") * 2 / size)).cast("int")
    parts = F.when(whole, F.array(F.lit(0))).when(few & (F.col("component") != F.col("main")), F.sequence(
        F.lit(0), F.ceil(F.col("n") * 2 / size).cast("int") - 1)).otherwise(F.array(dealt))
    return rows.select("node", "doc", "component", F.explode(parts).alias("part")).select(
        F.xxhash64("node", "part").alias("cell"), "doc", "component")


def join_sets(reps: DataFrame, bits: DataFrame, docs: DataFrame, settings: NearDupSettings, known: DataFrame | None) -> DataFrame | None:
    """(doc, component) of documents whose component is not their own id; ``known`` is the same, to begin with."""
    labels = known
    nodes = roots(reps, range(settings.first_trees), settings)
    level = 0
    while nodes is not None:
        nodes = write_once(nodes, "nodes")
        if labels is None:
            placed = nodes.withColumn("component", F.col("doc"))
            counts = placed.groupBy("node").agg(
                F.count("*").alias("n"), F.min("component").alias("main"), F.lit(1).cast("long").alias("main_n"))
        else:
            placed = nodes.join(labels, "doc", "left").select("node", "doc", F.coalesce("component", "doc").alias("component"))
            placed = write_once(placed, "placed")
            counts = placed.groupBy("node", "component").agg(F.count("*").alias("c")).groupBy("node").agg(
                F.sum("c").alias("n"), F.max_by("component", "c").alias("main"), F.max("c").alias("main_n"))
        counts = write_once(counts.where("n > main_n"), "node-counts")
        rows = write_once(placed.join(counts, "node"), "members")
        cells = cells_of(rows, settings.node_size, level).join(bits, "doc")
        clusters = write_once(likely_clusters(cells, settings).dropDuplicates(["cluster"]), "clusters")
        links = write_once(confirmed_links(clusters, docs, settings), "confirmed")
        labels = merged(labels, links)
        large = rows.where((F.col("n") > settings.node_size) & (F.col("n") - F.col("main_n") > settings.node_size // 2))
        nodes = None if large.isEmpty() else branch(large.select("node", "doc"), reps, settings)
        if level == 0 and settings.first_trees < settings.trees:
            more = roots(reps, range(settings.first_trees, settings.trees), settings)
            nodes = more if nodes is None else nodes.unionByName(more)
        level += 1
    return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after joining components by the links."""
    if links.isEmpty():
        return labels
    moved = write_once(components(links).where("id <> root"), "moved")
    fresh = moved.select(F.col("id").alias("doc"), F.col("root").alias("component"))
    if labels is None:
        return fresh
    old = labels.join(moved.select(F.col("id").alias("component"), "root"), "component", "left").select(
        "doc", F.coalesce("root", "component").alias("component"))
    return write_once(old.unionByName(fresh), "labels")


def near_duplicates(docs: DataFrame, settings: NearDupSettings = NearDupSettings(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sketched = write_once(sketch(narrow, settings), "sketches")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = write_once(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc")), "sets")
    # One row per distinct set. An id that has several sets is joined with itself by way of its least set's id.
    reps = write_once(filled.withColumnRenamed("doc_id", "doc").join(firsts, ["k1", "k2", "doc"]).select(
        "doc", "minima", "bits", "k1", "k2").dropDuplicates(["k1", "k2", "doc"]).select("doc", "minima", "bits"), "reps")
    owners = filled.select("doc_id", "k1", "k2").join(firsts, ["k1", "k2"]).select("doc_id", "doc")
    several = owners.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("doc_id", "a")
    known = merged(None, write_once(owners.join(several, "doc_id").select("a", F.col("doc").alias("b")).where(
        "a <> b").distinct(), "same-id"))
    labels = join_sets(reps.select("doc", "minima"), reps.select("doc", "bits"), narrow.where(F.col("doc_id").isNotNull()), settings, known)
    rows = sketched.select("doc_id", "n_shingles", "k1", "k2").join(firsts, ["k1", "k2"], "left").withColumn(
        "doc", F.when(F.col("n_shingles") > 0, F.col("doc")).otherwise(F.col("doc_id")))
    if labels is None:
        component = rows.withColumn("component", F.col("doc"))
    else:
        component = rows.join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    named = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return component.select("doc_id", "n_shingles", named.alias("component_id"), (F.col("doc_id") == named).alias("kept"))


def keep_one(docs: DataFrame, settings: NearDupSettings = NearDupSettings(), id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents without those whose component has a smaller id; all columns stay, rows with null ids too."""
    dropped = near_duplicates(docs, settings, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(dropped, docs[id_col] == dropped["_dropped"], "left_anti")
