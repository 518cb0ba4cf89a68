"""What tasks hold, and what their worker processes keep once they are over."""

from __future__ import annotations

import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from llm.cases import SCHEMA, prose
from pairsight.llm import near_dup, pieces

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KEEPS = """
import re
import numpy as np, pyarrow as pa
from pairsight.llm import arrow_text

def megabytes():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

pins = []
def run(batches):
    for batch in batches:
        held = [np.ones(8000) for _ in range(2000)]   # 128 MB
        pins.append(held[-1])                         # keeps the heap's end in place
        yield batch

before = megabytes()
wrap = getattr(arrow_text, "lean", lambda task: task)
rows = sum(b.num_rows for b in wrap(run)(iter([pa.record_batch({"n": [1, 2]})] * 3)))
print(rows, megabytes() - before)
"""


def test_worker_gives_back_what_its_tasks_freed():
    done = subprocess.run([sys.executable, "-c", KEEPS], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120)
    rows, kept = done.stdout.split()
    assert rows == "6" and float(kept) < 40


def test_pipeline_bounds_the_pieces_a_worker_keeps(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "KEPT_PIECES", 500)
    texts = [" ".join(f"w{i}x{k}" for k in range(300)) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(8)
    monkeypatch.setattr("pairsight.llm.packing.slices", lambda batch, column: (batch.slice(i, 1) for i in range(batch.num_rows)))

    def kept(batches):
        for _ in batches:
            pass
        sizes = [len(cache.place) for cache, _ in pieces._loaded.values() if cache.limit == 500]
        yield pa.record_batch({"n": pa.array(sizes, pa.int64())})

    packed = corpus_pipeline.pack_sequences(spark, docs, "")
    assert packed.count() >= 400
    sizes = [r.n for r in spark.range(0, 64, 1, 8).mapInArrow(kept, "n long").collect()]
    assert sizes and max(sizes) <= 500 + 2 * 301 + 1


def test_sets_are_made_slice_by_slice():
    texts = pa.array([prose(i, 400, 800) for i in range(300)] * 8 + ["", None])
    table = pa.table({"text": texts})
    peaks, found = [], []
    for make in (lambda: near_dup.shingle_sets(pa.concat_arrays(table.column("text").chunks).fill_null(""), 5),
                 lambda: near_dup.sliced_sets(table, 5)):
        tracemalloc.start()
        found.append(make())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    (values, counts), (sliced, numbers) = found
    assert np.array_equal(values, sliced) and np.array_equal(counts, numbers)
    assert peaks[1] < peaks[0] / 2
    assert [len(x) for x in near_dup.sliced_sets(table.slice(0, 0), 5)] == [0, 0]
