"""Structured Streaming forms of the binned event series (an addition: the batch operators are the reference point)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string") -> DataFrame:
    """A stream of the event files that appear in a folder; the schema is stated, never inferred."""
    return spark.readStream.schema(schema).parquet(folder)


def binned(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Mean, sum of squares and count of ``value`` by type and time bin; bins close ``late`` after their end.

    State is one small row per open bin and type.
    """
    v = F.col("value")
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.avg(v).alias("x"), F.sum(v * v).alias("xx"), F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "x", "xx", "n")


def write_bins(bins: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Closed bins appended to Parquet, each once, whatever restarts; runs until what is there is read."""
    return bins.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
