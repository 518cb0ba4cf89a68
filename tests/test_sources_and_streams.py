from __future__ import annotations

import datetime
import json

import pytest
from pyspark.sql import functions as F

from pairsight.plans.shared import write_once
from pairsight.sources import requests, synthetic, tables
from pairsight.streaming import jobs

CURATED = [
    {"drug": "warfarin", "food": "spinach", "risk_level": "HIGH", "mechanism": "m", "explanation": "e", "recommendations": "r"},
    {"drug": "warfarin", "food": "spinach", "risk_level": "HIGH", "mechanism": "m", "explanation": "e", "recommendations": "r"},
    {"drug": "milk", "food": "tetracycline", "risk_level": "LOW", "mechanism": "m", "explanation": "e", "recommendations": "r"},
]


def test_csv_bad_lines_and_encodings(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_bytes("drug,food\naspirin,milk\ntoo,many,fields\nshort\n\"a, b\",tea\n".encode())
    rows = {tuple(r) for r in tables.read_pairs_csv(spark, str(path), ["drug", "food"]).collect()}
    assert rows == {("aspirin", "milk"), ("short", None), ("a, b", "tea")}
    wide = tmp_path / "wide.csv"
    wide.write_bytes(b'id,drug,food\n1,NA,milk\n2,"a\nb",tea\n3,x,nan\n')
    got = {tuple(r) for r in tables.read_pairs_csv(spark, str(wide), multi_line=True).collect()}
    assert got == {("1", None, "milk"), ("2", "a\nb", "tea"), ("3", "x", None)}
    latin = tmp_path / "latin.csv"
    latin.write_bytes("drug,food\ncaf\xe9,th\xe9\n".encode("latin-1"))
    assert [tuple(r) for r in tables.read_pairs_csv(spark, str(latin), ["drug", "food"]).collect()] == [("café", "thé")]


def test_csv_encoding_is_decided_for_each_file(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes("drug,food\ncaf\u00e9,milk\none,two,three\nreal \ufffd,tea\n".encode())
    (folder / "b.csv").write_bytes("drug,food\nth\u00e9,milk\n\u00fc,2,3,4\n".encode("latin-1"))
    got = {tuple(r) for r in tables.read_pairs_csv(spark, str(folder), ["drug", "food"]).collect()}
    assert got == {("caf\u00e9", "milk"), ("real \ufffd", "tea"), ("th\u00e9", "milk")}
    dropped = {(r.file.rsplit("/", 1)[1], r.line) for r in tables.rejected_lines(spark, str(folder), ["drug", "food"]).collect()}
    assert dropped == {("a.csv", "one,two,three"), ("b.csv", "\u00fc,2,3,4")}


def test_curated_json_array(spark, tmp_path):
    path = tmp_path / "curated.json"
    path.write_text(json.dumps(CURATED, indent=2))
    curated = tables.read_curated_json(spark, str(path))
    assert curated.count() == 3 and tables.distinct_curated(curated).count() == 2


def test_missing_labelled_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        tables.read_labelled(spark, str(tmp_path / "none")).count()


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("drug,food,interaction,drug_category,food_category,mechanism,risk_level\na,b,1,c,d,e,HIGH\n")
    assert tables.read_labelled(spark, str(path), "csv").head()["interaction"] == 1


def test_synthetic_pairs(spark):
    frame = synthetic.synthetic_pairs(spark)
    assert frame.count() == 3000
    assert frame.select("drug").distinct().count() == frame.select("food").distinct().count() == 20
    assert sorted(frame.collect()) == sorted(frame.repartition(3).collect())


BODIES = [(1, '{"drug": " Aspirin\\t", "food": "milk"}'), (2, '{"drug": "", "food": "milk"}'), (3, '{"drug": "aspirin"}'),
          (4, '{"drug": "aspirin"'), (5, None), (6, '{"drug": "warfarin", "food": "spinach", "more": 1}')]


def test_requests_and_envelopes(spark):
    frame = spark.createDataFrame(BODIES, "id int, body string")
    decoded = requests.decode_requests(frame, "body")
    assert {r["id"]: r["left_name"] for r in requests.accepted(decoded).collect()} == {1: "Aspirin", 6: "warfarin"}
    assert {r["id"] for r in requests.rejected(decoded).collect()} == {2, 3, 4, 5}
    record = F.struct(F.col("left_name").alias("drug"))
    wrapped = requests.accepted(decoded).select(requests.success_envelope(record).alias("e"), F.to_json(record).alias("bare"))
    row = wrapped.select("e", requests.unwrap(F.col("e")).alias("u"), requests.unwrap(F.col("bare")).alias("b")).head()
    assert json.loads(row["e"])["success"] is True and row["u"] == row["b"] == '{"drug":"Aspirin"}'
    assert json.loads(frame.select(requests.error_envelope(F.lit("x")).alias("e")).head()["e"]) == {"success": False, "error": "x"}


def test_scoring_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    frame = spark.createDataFrame(BODIES, "id int, body string")
    frame.repartition(3).write.parquet(str(source))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    out, bad, state = (str(tmp_path / n) for n in ("out", "bad", "state"))
    jobs.run_scoring_stream(jobs.enrich_requests(stream, "body"), lambda b: b, out, bad, state).awaitTermination()
    got = {(r["id"], r["mechanism"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "unknown"), (6, "vitamin_k_competition")}
    assert {r["id"] for r in spark.read.parquet(bad).collect()} == {2, 3, 4, 5}


def test_late_rows_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    # The watermark a batch applies to late rows is the one known when the batch before it began.
    days = ["2024-01-01 10:00:00", "2024-01-03 10:00:00", "2024-01-03 12:00:00", "2024-01-01 11:00:00", "2024-01-06 00:00:00"]
    for i, day in enumerate(days):
        spark.createDataFrame([(day, "HIGH")], "t string, risk_level string").select(
            F.col("t").cast("timestamp").alias("ts"), "risk_level").coalesce(1).write.mode("append").parquet(str(source / f"p={i}"))
    stream = spark.readStream.schema("ts timestamp, risk_level string").option("maxFilesPerTrigger", 1).parquet(str(source / "p=*"))
    out = str(tmp_path / "out")
    jobs.run_table_stream(jobs.risk_counts(stream, "ts"), out, str(tmp_path / "state")).awaitTermination()
    rows = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-03": 2}  # the late row and the open last day are missing


def test_write_once_round_trip(spark):
    frame = spark.range(5).withColumn("s", F.lit("x"))
    assert sorted(write_once(frame, "t").collect()) == sorted(frame.collect())


def test_open_windows_are_counted_and_restarts_add_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "ts timestamp, risk_level string"

    def add(rows):
        spark.createDataFrame([(datetime.datetime(2024, 1, d, h), r) for d, h, r in rows], schema).coalesce(1).write.mode(
            "append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_counts_stream(jobs.risk_counts(stream, "ts"), out, state).awaitTermination()
        found = jobs.latest_counts(spark.read.parquet(out)).collect()
        return sorted((r.window_start.day, r.risk_level, r.n) for r in found)

    add([(1, 3, "HIGH"), (1, 4, "HIGH"), (2, 5, "LOW")])
    assert run() == [(1, "HIGH", 2), (2, "LOW", 1)]
    assert run() == [(1, "HIGH", 2), (2, "LOW", 1)]
    add([(2, 6, "LOW"), (3, 1, "HIGH")])
    assert run() == [(1, "HIGH", 2), (2, "LOW", 2), (3, "HIGH", 1)]
