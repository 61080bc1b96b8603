"""Readers and writers of text, JSON and binary artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row for each text file."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_artifacts(spark: SparkSession, path: str, stem: str | None = None) -> DataFrame:
    """(path, payload): JSON files below ``path`` of a document; unreadable ones are skipped.

    A file belongs to ``stem`` if its name or content holds it, or its name says
    validation, audit or evidence.
    """
    files = read_texts(spark, path).where(F.col("path").endswith(".json")).select("path", F.col("text").alias("payload"))
    files = files.where(F.expr("try_parse_json(payload) is not null"))
    if stem is None:
        return files
    return files.where(F.col("path").contains(stem) | F.col("payload").contains(stem) | F.col("path").rlike("(?i)validation|audit|evidence"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, hash) of every file below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, state): ok, changed, missing or extra."""
    joined = found.select("path", F.col("hash").alias("now")).join(manifest.select("path", F.col("hash").alias("then")), "path", "full")
    return joined.select("path", F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "extra").when(F.col("now") == F.col("then"), "ok").otherwise("changed").alias("state"))


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Rows as JSON lines, in folders by ``by``; keys are written in order of name."""
    ordered = df.select(*sorted(df.columns))
    (ordered.write.partitionBy(*by) if by else ordered.write).mode("overwrite").json(path)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs not yet among the finished ones: resuming a batch."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def write_table(df: DataFrame, path: str, most_csv_rows: int = 1000) -> bool:
    """Rows as Parquet, and as CSV beside it when there are fewer than ``most_csv_rows``; says whether CSV was written."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    small = len(df.take(most_csv_rows)) < most_csv_rows
    if small:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    return small
