"""Reading pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsight.plans.shared import write_once

LABELLED_SCHEMA = (
    "drug string, food string, interaction int, drug_category string, food_category string, "
    "mechanism string, risk_level string")
CURATED_SCHEMA = (
    "drug string, food string, risk_level string, mechanism string, explanation string, recommendations string")


# Cell texts that count as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_pairs_csv(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False,
                   missing: list[str] = MISSING) -> DataFrame:
    """CSV with a header, every column read as a string.

    ``columns`` are all columns of the file in order; by default the header line is asked. Lines
    with too many fields are dropped (``rejected_lines`` has them) and lines with too few are padded with nulls. A
    file that is not valid UTF-8 is read as Latin-1 instead, whatever the other files are.
    ``multi_line`` allows quoted line breaks; such files cannot be split.
    """
    columns = columns or _header(spark, path)
    rows = _by_encoding(spark, path, columns, multi_line).where(F.col("_extra").isNull())
    return rows.select(*[F.when(~F.col(c).isin(missing), F.col(c)).alias(c) for c in columns])


def rejected_lines(spark: SparkSession, path: str, columns: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """(file, line): the lines that ``read_pairs_csv`` drops because they have too many fields."""
    columns = columns or _header(spark, path)
    rows = _by_encoding(spark, path, columns, multi_line, "_line").where(F.col("_extra").isNotNull())
    # A line with one field too many fits the schema of the read, so it is put together again.
    line = F.coalesce("_line", F.to_csv(F.struct(*columns, "_extra"), {"escape": '"'}))
    return rows.select(F.col("_file").alias("file"), line.alias("line"))


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def _by_encoding(spark: SparkSession, path: str, columns: list[str], multi_line: bool, *more: str) -> DataFrame:
    """All lines with ``_extra`` and ``_file``, each file in its own encoding."""
    file = F.col("_metadata.file_path").alias("_file")
    # The text reader keeps the bytes of a line as they are. One row for each file at most.
    other = write_once(spark.read.text(path).where(~F.is_valid_utf8("value")).select(file).distinct(), "latin-files")
    utf8 = _csv(spark, path, columns, "UTF-8", multi_line, *more)
    if not other.limit(1).count():
        return utf8
    latin = _csv(spark, path, columns, "ISO-8859-1", multi_line, *more)
    return utf8.join(F.broadcast(other), "_file", "left_anti").unionByName(
        latin.join(F.broadcast(other), "_file", "left_semi"))


def _csv(spark: SparkSession, path: str, columns: list[str], encoding: str, multi_line: bool, *more: str) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in [*columns, "_extra", *more])
    read = spark.read.schema(schema).option("header", True).option("encoding", encoding).option(
        "enforceSchema", True).option("escape", '"').option("mode", "PERMISSIVE").option("multiLine", multi_line).option(
        "columnNameOfCorruptRecord", "_line")
    return read.csv(path).select(*columns, "_extra", *more, F.col("_metadata.file_path").alias("_file"))


def read_labelled(spark: SparkSession, path: str, file_format: str = "parquet", schema: str = LABELLED_SCHEMA) -> DataFrame:
    """Labelled pair table with a fixed schema. A missing path is an error."""
    reader = spark.read.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.format(file_format).load(path)


def read_curated_json(spark: SparkSession, path: str, schema: str = CURATED_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Curated pairs from JSON arrays (or, with ``multi_line`` off, one record per line). Repeats stay."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def distinct_curated(curated: DataFrame) -> DataFrame:
    """One record per pair; of differing records the smallest is kept, so the choice is repeatable."""
    rest = [c for c in curated.columns if c not in ("drug", "food")]
    kept = curated.groupBy("drug", "food").agg(F.min(F.struct(*rest)).alias("_r"))
    return kept.select("drug", "food", "_r.*")
