"""Append logs as streams: removal of repeated events and tumbling counts, with late rows up to a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.session import shared_dir


def read_events(spark: SparkSession, glob: str) -> DataFrame:
    """The files of a log as a stream; times without zone are taken as UTC, for watermarks need an instant."""
    schema = spark.read.parquet(glob).schema
    return spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once; state is kept for the delay only."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events, users' sum of values and the greatest value by type and window."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"), F.max("value").alias("most")).select(F.col("w.start").alias("window_start"), "event_type", "events", "value", "most")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now: written to the shared folder, then read.

    In append mode windows that the watermark has not passed stay open and are not given; in complete mode every window is,
    each batch's result taking the place of the one before.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":  # files can only be appended to
        spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out")
        writer = stream.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{at}/out"))
    else:
        writer = stream.writeStream.format("parquet").option("path", f"{at}/out")
    q = writer.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
