"""Event streams: windowed counts with a watermark, their updates in a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A directory or file of events as a stream; ts becomes an event time in UTC."""
    schema = spark.read.parquet(path).schema
    any_kind = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that a single file will do
    return spark.readStream.schema(schema).parquet(any_kind).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """day, event_type, n, total per tumbling window; in update mode the state of windows behind the watermark is dropped."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def run_available(spark: SparkSession, stream: DataFrame, keys: tuple[str, ...] = ("day", "event_type")) -> DataFrame:
    """Run a stream over all input that is there; the last update of each key.

    Each micro-batch appends its updates to a table in the shared folder, where the checkpoint is too: a batch that is run again
    replaces its own part, and nothing passes through the driver.
    """
    at = f"{own_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{at}/updates/part={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    spark.createDataFrame([], stream.schema.add("_batch", "long")).write.parquet(f"{at}/updates/part=-1")  # a stream without any batch has no updates
    updates = spark.read.parquet(f"{at}/updates").drop("part")
    values = [c for c in updates.columns if c not in (*keys, "_batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return last.select(*keys, *(f"_v.{c}" for c in values))
