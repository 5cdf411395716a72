"""Queries over signals: cleaning, peaks, physiological features, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import series as S
from ..operators import signal as P
from . import inputs as I
from .registry import query


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's hourly series as one array, hours in order."""
    r = I.runs(spark, sf_dir).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s"))
    return r.select("run", F.transform("s", lambda e: e["x"]).alias("ts"))


def _long(df: DataFrame) -> DataFrame:
    return df.select("run", F.posexplode("ts").alias("t", "x")).withColumn("x", F.round("x", 6))


UP, DOWN = 2, 3
_REACH = 10 * max(UP, DOWN)


@query(
    "resampled_series",
    f"""WITH s AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS ix, x FROM {I.RUNS_SQL}),
    h(j, w) AS (VALUES {", ".join(f"({j}, CAST('{float(w)!r}' AS DOUBLE))" for j, w in zip(range(-_REACH, _REACH + 1), K.polyphase_filter(UP, DOWN)))}),
    n AS (SELECT run, (count(*) * {UP} + {DOWN - 1}) // {DOWN} AS n FROM s GROUP BY run), m AS (SELECT run, unnest(range(0, CAST(n AS BIGINT))) AS ix FROM n)
    SELECT m.run, m.ix, round(sum(s.x * h.w), 6) AS x FROM m JOIN s ON s.run = m.run AND abs(m.ix * {DOWN} - s.ix * {UP}) <= {_REACH} JOIN h ON h.j = m.ix * {DOWN} - s.ix * {UP} GROUP BY 1, 2""",
)
def resampled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each type's series at two thirds of its rate."""
    s = S.concat_runs(I.runs(spark, sf_dir), "run", ["t"], "n")
    s = s.join(s.groupBy("run").agg(F.min("n").alias("_n")), "run").withColumn("ix", F.col("n") - F.col("_n"))
    return P.resampled(s, "x", "run", "ix", UP, DOWN, chunk=256).withColumn("x", F.round("x", 6))


@query("high_pass")
def high_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimmed, detrended, high-passed and standardised series."""
    return _long(P.clean_voxels(voxels(spark, sf_dir), tr=1.5, trim=10))


@query("band_pass")
def band_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(P.clean_voxels(voxels(spark, sf_dir), tr=1.5, high_pass=0.01, low_pass=0.1, order=5))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made recording per event type at 10 Hz, shifted by its hourly values: breath, pulse and two gases."""
    s = I.runs(spark, sf_dir).withColumn("ix", F.col("t").cast("int"))
    t = F.col("ix") / 10.0
    noise = F.col("x") / 5000
    return s.select(
        "run", "ix", (F.sin(t * 2 * 3.14159265 * 1.1) + noise).alias("cardiac"), (F.sin(t * 2 * 3.14159265 * 0.25) + noise).alias("respiratory_effort"),
        (40 + 2 * F.sin(t * 2 * 3.14159265 * 0.25) + noise).alias("respiratory_CO2"), (110 - 3 * F.sin(t * 2 * 3.14159265 * 0.25) + noise).alias("respiratory_O2"),
    )


@query("physio_features")
def physio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recording to features at every frame of 1.5 s that it covers."""
    out = P.process_physio(recording(spark, sf_dir), "run", ["cardiac", "respiratory_effort", "respiratory_CO2", "respiratory_O2"], 10.0, 1.5, None)
    return out.select("run", "t", *[F.round(c, 5).alias(c) for c in out.columns if c not in ("run", "t")])


@query("end_tidal")
def end_tidal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.end_tidal(recording(spark, sf_dir), "run", "ix", "respiratory_O2", 10.0, inverted=True).withColumn("value", F.round("value", 5))


@query("spaced_peaks")
def spaced_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks at least six hours apart, at most twenty a type."""
    return P.peak_table(I.runs(spark, sf_dir), "run", "t", "x", height=240.0, distance=6, top=20).withColumn("height", F.round("height", 6))


@query("smooth_volume")
def smooth_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .label_queries import volume

    v = volume(spark, sf_dir).withColumnRenamed("v", "x")
    return P.smooth(v, 4.0, 2.0).withColumn("x", F.round("x", 6))
