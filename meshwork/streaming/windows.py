"""Counts over windows of event time, for tables and streams alike.

Not derived from a query of the engine's language; the events table is the use that it has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.plans.lineage import scratch


def timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream's rows under a watermark, which needs an instant; the session's time zone gives and takes it alike."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def tumbling(events: DataFrame, time: str, length: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """(start, by, n): rows in each window of that length. A stream drops what comes later than `late`."""
    rows = timed(events, time, late)
    return rows.groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """(start, by, n): rows in each run of rows without a gap of that length."""
    rows = timed(events, time, late)
    return rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling counts of the events table read as a stream, until all that is there is done.

    Windows that the watermark hasn't closed are part of the result, so each batch's groups replace earlier ones: they
    are appended with the batch's number, and the last of each group counts.
    """
    path = f"{sf_dir}/events.parquet"
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(path if path.endswith("/") else f"{sf_dir}/events.parquet*")
    counts = tumbling(source, "ts", "1 hour", ["event_type"], "60 days")
    out, state = scratch(spark, "stream"), scratch(spark, f"stream-state-{uuid.uuid4().hex[:8]}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("start timestamp_ntz, event_type string, n long, batch int").parquet(out)
    return done.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
