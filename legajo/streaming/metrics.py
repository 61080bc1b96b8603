"""Structured Streaming forms of the operational metrics; each ends with the batch result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legajo.functions.session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, sf_dir: str, lateness: str = "1 day") -> DataFrame:
    """The events table as a stream with event time ``at``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 8).parquet(sf_dir)
    return stream.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Process all that is available and give the sink's rows; state and rows lie in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def hour_counts(events: DataFrame) -> DataFrame:
    """(hour, event_type, n) in tumbling hours."""
    counted = events.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("string").alias("hour"), "event_type", "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    """(start, event_type, n, mean_value) in windows of two hours every hour."""
    counted = events.groupBy(F.window("at", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg(F.coalesce("value", F.lit(0.0))).alias("m"))
    return counted.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", F.round(F.lit(1e-9) + F.col("m"), 6).alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, opened, n): sessions of events less than ``gap`` apart."""
    counted = events.groupBy(F.session_window("at", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("s.start").cast("string").alias("opened"), "n")


def streamed(form: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that runs ``form`` over the stream of events to its end."""
    return lambda spark, sf_dir: run_to_end(form(event_stream(spark, sf_dir)))
