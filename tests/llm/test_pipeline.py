"""The pipeline against the operators' brute-force versions, stage by stage, and the guard around the subpackage."""

from __future__ import annotations

import os
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from llm.cases import AWKWARD, SCHEMA, prose
from llm.test_models import toxic_corpus
from llm.test_near_dup import brute
from llm.test_rules import brute_quality
from pairsight.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_and_result(spark, monkeypatch):
    rows, labels = toxic_corpus(400)
    rows += [(1000 + i, prose(i, 60, 800)) for i in range(0, 60, 2)] + [(2000 + i, t) for i, t in AWKWARD if i is not None and i < 16]
    rows += [(3000, "the same five words again " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    monkeypatch.setattr(queries, "load", lambda s, d, n: {"documents": docs, "labels": marks}[n])

    good = {i for i, t in rows if brute_quality(t)[-1]}
    first = corpus_pipeline.quality_rules(spark, docs, "")
    assert first.schema == docs.schema and {r.doc_id for r in first.collect()} == good
    civil = corpus_pipeline.remove_toxic(spark, first, "")
    civil_rows = {r.doc_id: r.text for r in civil.collect()}
    rude = {i for i, t in rows if any(w in (t or "").lower() for w in ("grubby", "rotten", "vile"))}
    assert civil.schema == docs.schema and set(civil_rows) <= good and len(good - rude - set(civil_rows)) <= 2
    assert len(rude & set(civil_rows)) <= 0.1 * len(rude)
    kept = {root for _, _, root in brute(sorted(civil_rows.items()), 80)}
    third = corpus_pipeline.drop_near_duplicates(spark, civil, "")
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == kept

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    want = {i: encode.encode(civil_rows[i], add_special_tokens=False).ids + [1] for i in kept}
    found, lengths = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, "").collect():
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        found[r.doc_id] += r.length
        lengths[r.sequence_id] += r.length
    assert found == {i: len(w) for i, w in want.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())


def test_pipeline_of_nothing(spark, monkeypatch):
    empty = spark.createDataFrame([], SCHEMA)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(queries, "load", lambda s, d, n: {"documents": empty, "labels": marks}[n])
    assert corpus_pipeline.run(spark, "").count() == 0


def test_every_operator_is_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "packing"]


def test_library_works_without_the_subpackage(tmp_path):
    """A copy of the repository without the subpackage and the pipeline still has the other queries."""
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "pairsight"), copy / "pairsight", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rule_join' in q and not any(n.startswith('op') for n in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


def test_other_import_errors_are_not_swallowed(tmp_path):
    import shutil

    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "pairsight"), copy / "pairsight", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(ROOT, name), copy)
    with open(copy / "pairsight" / "llm" / "packing.py", "a") as out:
        out.write("\nimport no_such_module_anywhere\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module_anywhere" in done.stderr
