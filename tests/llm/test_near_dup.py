"""Near-duplicate components against all pairs compared by brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm.cases import AWKWARD, documents, lower, words
from pairsight.llm import near_dup
from pairsight.llm.components import components
from pairsight.llm.near_dup import NearDupSettings


def shingles(text):
    w = words(lower(text))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows, percent):
    sets, parent = defaultdict(list), {}
    for i, t in rows:
        sets[i].append(shingles(t))
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for n, (i, a) in enumerate(flat):
        for j, b in flat[:n]:
            shared = len(a & b)
            if find(i) != find(j) and 100 * shared >= percent * (len(a) + len(b) - shared):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted((i, len(shingles(t)), find(i)) for i, t in rows)


def run(spark, rows, **settings):
    got = near_dup.near_duplicates(documents(spark, rows), NearDupSettings(**settings)).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    return got


def copies(seed, groups, vocabulary=4000):
    """Texts in groups of edited copies, from none to many edits."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(vocabulary)}"
    rows = []
    for size, length, edits in groups:
        base = [word() for _ in range(length)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randint(0, edits)):
                text[draw.randrange(length)] = word()
            rows.append((len(rows) * 3, " ".join(text)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_groups_of_copies(spark, percent):
    rows = copies(percent, [(2, 60, 2)] * 25 + [(5, 150, 6)] * 8 + [(1, 80, 0)] * 40 + [(60, 200, 4), (40, 12, 1), (30, 5, 1), (20, 3, 1)])
    got = run(spark, rows, percent=percent)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, percent)


def test_large_nodes_branch(spark):
    """Cells far smaller than the groups: one dense group, and many texts that share a long passage only."""
    rows = copies(1, [(260, 150, 2)])
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(5000 + i, passage + " " + " ".join(f"u{draw.randrange(9000)}" for _ in range(40))) for i in range(150)]
    got = run(spark, rows, percent=85, node_size=32)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 85)


def test_awkward_rows(spark):
    rows = [(i, t) for i, t in AWKWARD if i is not None] + [(20, "A  b\nC"), (21, "a b c"), (22, "a b c d e"), (23, "a b c d e f")]
    got = run(spark, [(None, "a b c"), *rows], percent=85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows, 85)
    null = next(r for r in got if r.doc_id is None)
    assert (null.n_shingles, null.component_id, null.kept) == (1, None, None)
    assert run(spark, [], percent=85) == []


def test_one_id_with_two_texts_joins_both(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, one), (2, one), (2, two), (3, two), (3, two), (4, "else where")]
    got = run(spark, rows, percent=85)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)} and len(got) == 6


def test_keep_one_leaves_whole_rows(spark):
    rows = copies(5, [(4, 60, 1)] * 5 + [(1, 60, 0)] * 5) + [(None, "x y"), (900, "")]
    docs = documents(spark, rows)
    kept = near_dup.keep_one(docs, NearDupSettings(percent=85))
    named = [(i, t) for i, t in rows if i is not None]
    want = {root for _, _, root in brute(named, 85)} | {None}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_chains_have_one_component(spark):
    draw = random.Random(1)
    ids = draw.sample(range(10 ** 12), 300)
    links = [(a, b) for a, b in zip(ids[:200], ids[1:200])] + [(ids[200], i) for i in ids[201:]] + [(ids[5], ids[9]), (ids[5], ids[5])]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: min(ids[:200]) for i in ids[:200]}, **{i: min(ids[200:]) for i in ids[200:]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minima_estimate_similarity():
    draw = random.Random(2)
    a = " ".join(f"w{draw.randrange(10 ** 6)}" for _ in range(600))
    b = " ".join(a.split()[:540] + [f"v{i}" for i in range(60)])
    values, counts = near_dup.shingle_sets(pa.array([a, b, ""]), 5)
    minima = near_dup.minima_of(values, counts, 512)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((minima[0] == minima[1]).mean() - true) < 0.08 and counts.tolist() == [596, 596, 0]
    assert not np.array_equal(minima[0], minima[2])
