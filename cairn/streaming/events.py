"""Structured Streaming over the events table: an extension, as evidence tables themselves are batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.shared import shared_dir


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files under path that are named like the events table."""
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return s.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "purchases")


def drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give its result table: the last written one in complete mode, else all of them.

    Each batch is written by its tasks to a folder of its own number in the shared folder, so a batch that runs again replaces itself.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    written: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return spark.createDataFrame([], stream.schema)
    last = [max(written)] if mode == "complete" else sorted(set(written))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in last])
