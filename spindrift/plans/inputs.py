"""The standard tables seen as series, runs and events, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: Hours since the start of 2024; calendar functions, so the session's time zone plays no part.
HOUR_SQL = "(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 24 + hour(ts))"


def hour() -> F.Column:
    return (F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")


def seconds() -> F.Column:
    """Seconds since the start of 2024, without fractions."""
    return hour() * 3600 + F.minute("ts") * 60 + F.second("ts")


SECONDS_SQL = f"({HOUR_SQL} * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ``event_id, run, trial_type, onset`` (hours), ``x`` and the raw columns."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({"t": hour(), "sec": seconds(), "trial_type": F.col("event_type"), "x": F.col("value")})


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, x``: the mean value of each hour over all events."""
    return events(spark, sf_dir).groupBy("t").agg(F.avg("x").alias("x"))


HOURLY_SQL = f"(SELECT {HOUR_SQL} AS t, avg(value) AS x FROM events GROUP BY 1)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run, t, x``: the hourly mean of each event type."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("run"), "t").agg(F.avg("x").alias("x"))


RUNS_SQL = f"(SELECT event_type AS run, {HOUR_SQL} AS t, avg(value) AS x FROM events GROUP BY 1, 2)"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``t, label, voxel, x``: the embeddings as a matrix, time by position."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), "label", F.posexplode("embedding").alias("voxel", "x")).withColumn("x", F.col("x").cast("double"))


def length(spark: SparkSession, sf_dir: str) -> int:
    """How many frames the matrix has, gaps included."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0]
    return 0 if last is None else last + 1


MATRIX_SQL = "(SELECT t, label, CAST(voxel - 1 AS INTEGER) AS voxel, CAST(embedding[voxel] AS DOUBLE) AS x FROM (SELECT vec_id AS t, label, embedding, unnest(range(1, len(embedding) + 1)) AS voxel FROM embeddings))"
