"""Token ids as Parquet: one row per document, ids in a list column, in ascending document order.

Layout of a file: ``part`` (position of the file's range), ``doc_id``, ``n_tokens``, ``local_start`` (ids before the
document in its part) and ``ids``. Ids are dictionary-encoded (a vocabulary below 65,536 takes 16 bits an
id), ``doc_id`` and ``local_start`` are delta-encoded (Parquet v2 pages), row groups and pages have set sizes, and
column and offset indexes are written, so a reader of a few documents or of the metadata alone skips the ids.

Defined cases: null text is the empty text (its end id remains); rows are ordered by (id, text hash), so repeated
ids stay separate rows and are dealt out even if one id is frequent; a null id sorts first; an empty table
gives an empty file set; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairsight.llm.arrow_text import as_text, slices
from pairsight.llm.pieces import append_to_each, encode_texts, tokenizer_pieces, without_threads

FILE_SCHEMA = "part int, doc_id long, n_tokens long, local_start long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def encode_documents(docs: DataFrame, path: str, kind: str = "word", end_id: int | None = None) -> DataFrame:
    """Encode (doc_id, text) rows in their order: the columns of a token file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_threads()
        cache, cut = tokenizer_pieces(path, kind)
        before = 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encode_texts(as_text(part.column("text")), cache, cut)
                if end_id is not None:
                    ids, counts = append_to_each(ids, counts, end_id)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()),
                                                 pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                    "local_start": pa.array(before + ends - counts, pa.int64()), "ids": lists})
                before += int(ends[-1]) if len(ends) else 0

    encoded = docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, local_start long, ids array<int>")
    return encoded.select(F.spark_partition_id().alias("part"), "*")


def write_token_files(docs: DataFrame, target: str, path: str, kind: str = "word", end_id: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them in ascending id order, one file per range."""
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    key = F.xxhash64("text")
    ordered = narrow.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    (encode_documents(ordered, path, kind, end_id).write.mode("overwrite")
     .option("compression", "zstd")
     .option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#local_start", "false")
     .option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES))
     .option("parquet.page.row.count.limit", "2000")
     .parquet(target))


def read_token_files(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(target)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: the totals of earlier parts plus the local start.

    Totals come from a scan of two narrow columns. There is one row per part, however many documents,
    so the running sum over them is small, and so is what the join broadcasts.
    """
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("local_start")).drop("_base")


def id_checksums(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: unsigned CRC-32 of the ids as little-endian 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            data = memoryview(lists.flatten().to_numpy().astype("<u4")).cast("B")
            ends = (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()) * 4
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            columns = {c: batch.column(batch.schema.get_field_index(c)) for c in kept}
            yield pa.RecordBatch.from_pydict({**columns, "ids_crc32": pa.array(sums, pa.int64())})

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", ids_crc32 long")
