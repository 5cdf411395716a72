"""Workflows: what the command lines do, as functions that build lazy plans and trigger one write each.

A study is a folder of Parquet: ``func`` (run_id, task, ses, voxel_id, ts), ``physio`` (run_id, task, ses,
ix, one column a signal), ``events`` (run_id, task, ses, onset, duration, trial_type), partitioned by task
and session, so a selection opens only what it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as M
from ..operators import basis as B
from ..operators import decay as D
from ..operators import linear as L
from ..operators import regressors as E
from ..operators import series as S
from ..operators import signal as P
from ..sources import catalog as C
from ..sources import tables as T
from ..sources.shared import cut
from ..sources.sinks import write_result


def load(spark: SparkSession, study: str, kind: str, task: str, sessions: Sequence[str] | None = None) -> DataFrame:
    """One kind of data of a task; an unknown kind or a session that isn't there is an error."""
    if kind not in ("func", "physio", "events"):
        raise ValueError("kind must be func, physio or events")
    df = spark.read.parquet(f"{study}/{kind}").where(F.col("task") == task)
    if sessions is not None:
        there = {str(r[0]) for r in df.select("ses").distinct().collect()}
        if missing := sorted(set(sessions) - there):
            raise ValueError(f"{task} has no session {missing}")
        df = df.where(F.col("ses").cast("string").isin(list(sessions)))
    return df


def complete_runs(*frames: DataFrame) -> list[DataFrame]:
    """The frames, each with only the runs that all of them have."""
    runs = frames[0].select("run_id").distinct()
    for f in frames[1:]:
        runs = runs.join(f.select("run_id").distinct(), "run_id", "left_semi")
    return [f.join(runs, "run_id", "left_semi") for f in frames]


def voxel_rows(func: DataFrame) -> DataFrame:
    """``run, voxel, ts`` with runs z-scored apart; constant voxels are zeros. Map-only."""
    return func.select(F.col("run_id").alias("run"), F.col("voxel_id").alias("voxel"), standardised("ts").alias("ts"))


def preprocess(spark: SparkSession, study: str, out: str, task: str, tr: float, trim: int = 10, high_pass: float = 0.01) -> None:
    """Functional series of a task cleaned, map-only, and written."""
    clean = P.clean_voxels(load(spark, study, "func", task), tr, high_pass, trim=trim)
    clean.where(F.size("ts") > 0).write.mode("overwrite").partitionBy("task", "ses").parquet(f"{out}/func")


def preprocess_physio(spark: SparkSession, study: str, out: str, task: str, columns: Sequence[str], rate: float, tr: float, n_volumes: int) -> None:
    """Recordings of a task to features at frame times, written as tab-separated files."""
    got = P.process_physio(load(spark, study, "physio", task), "run_id", list(columns), rate, tr, n_volumes)
    got.write.mode("overwrite").option("sep", "\t").option("compression", "gzip").partitionBy("run_id").csv(f"{out}/physio", header=True)


def physio_response(func: DataFrame, physio: DataFrame, signal: str, lags: range = range(-15, 16), df: int = 5, penalty: float = 10_000.0) -> DataFrame:
    """``voxel, lag, y``: each voxel's response to a unit of a physiological signal."""
    func, physio = complete_runs(func, physio)
    spark = func.sparkSession
    basis = B.basis_table(spark, lags, df)
    s = physio.select(F.col("run_id").alias("run"), F.col("ix").alias("t"), F.col(signal).alias("x"))
    design = S.zscore(B.project(s, basis, ["run"], "t", "x", len(lags)), "v", ["k"]).select("run", "t", "k", F.col("z").alias("x"))
    return L.predict(L.ridge_series(design, voxel_rows(func), penalty), basis)


def event_response(func: DataFrame, events: DataFrame, tr: float, penalty: float = 1.0, extend: float = 15.0) -> DataFrame:
    """``trial_type, time, voxel, y``: each voxel's response to each trial type."""
    func, events = complete_runs(func, events)
    frames = func.groupBy(F.col("run_id").alias("run")).agg((F.max(F.size("ts")) - 1).cast("long").alias("t"))  # the last frame of each run
    design, shapes = E.event_design(frames, events.withColumnRenamed("run_id", "run"), tr, extend=extend)
    return E.evaluate_events(L.ridge_series(design, voxel_rows(func), penalty), shapes)


def standardised(ts: str) -> Column:
    """An array less its mean, over its population deviation; a constant one is zeros."""
    n, add = F.size(ts), lambda a, x: a + x
    mean = F.aggregate(ts, F.lit(0.0), add) / n
    square = F.aggregate(ts, F.lit(0.0), lambda a, x: a + x * x) / n
    sd = F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    return F.transform(ts, lambda x: F.coalesce((x - mean) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)))


def end_to_end(func: DataFrame) -> DataFrame:
    """``voxel, ts``: each voxel's runs, standardised apart, laid end to end by run name."""
    rows = func.select(F.col("voxel_id").alias("voxel"), "run_id", standardised("ts").alias("ts"))
    joined = rows.groupBy("voxel").agg(F.sort_array(F.collect_list(F.struct("run_id", "ts"))).alias("_r"))
    return joined.select("voxel", F.flatten(F.transform("_r", lambda r: r["ts"])).alias("ts"))


def components(func: DataFrame, k: int = 10) -> tuple[pd.DataFrame, DataFrame]:
    """Scores over time and loadings of all voxels, runs end to end."""
    return L.pca_time(end_to_end(func), "voxel", "ts", k)


def multiecho(spark: SparkSession, files: DataFrame, mask: DataFrame, task: str, echo_times: Sequence[float], sessions: Sequence[str] | None = None) -> DataFrame:
    """``path, sub, ses, task, run, i, j, k, s0, t2star`` of each run of the catalog ``files``; ``path`` is its first echo.

    Every run must have as many echoes as there are times (milliseconds). Voxels of ``mask (i, j, k)`` with two
    good echoes or more (``decay.adaptive_mask`` of the run) are fitted, all other voxels of the grid are zeros. Voxels shuffle once, to meet their echoes.
    """
    D.check_echo_times(echo_times)
    runs = C.echo_sets(C.select(files, task=task, ses=sessions, suffix="bold", extension=".nii.gz"), len(echo_times))
    each = runs.select(F.get("paths", F.lit(0)).alias("first"), F.posexplode("paths").alias("echo", "path"))
    paths = [r["path"] for r in each.select("path").collect()]  # names of files, which Spark lists on the driver, too
    if not paths:
        raise ValueError(f"no echoes of {task}")
    voxels = T.read_nifti(spark, paths).join(each, "path")
    where = ["first", "i", "j", "k"]
    inside = voxels.join(mask.select("i", "j", "k").distinct(), ["i", "j", "k"], "left_semi")
    cubes = D.adaptive_mask(cut(T.echo_cube(inside, where)), by=["first"]).withColumn("voxel_id", F.lit(0))
    fits = D.fit_decay(cubes, echo_times, keep=where).drop("voxel_id", "n_good")
    zeros = F.array_repeat(F.lit(0.0), F.col("_n"))
    grid = voxels.where("echo = 0").select(*where, F.size("ts").alias("_n")).join(fits, where, "left")
    maps = grid.select(*where, F.coalesce("s0", zeros).alias("s0"), F.coalesce("t2star", zeros).alias("t2star"))
    about = runs.select(F.get("paths", F.lit(0)).alias("path"), "sub", "ses", "task", "run")
    return about.join(maps.withColumnRenamed("first", "path"), "path")


def write_multiecho(maps: DataFrame, out: str, space: str | None = None) -> None:
    """Both maps of each run as Parquet ``(i, j, k, ts)`` in ``out/ses=.../name=...``, named after the first echo."""
    base = F.regexp_extract("path", "([^/]*)$", 1)
    one = lambda kind, column: maps.select("ses", M.decay_name(base, kind, space).alias("name"), "i", "j", "k", F.col(column).alias("ts"))
    one("t2", "t2star").unionByName(one("s0", "s0")).write.mode("overwrite").partitionBy("ses", "name").parquet(out)


ANALYSES = ("dlm_physio", "dlm_event", "pca")


def analyse(spark: SparkSession, study: str, out: str, task: str, analysis: str, tr: float, signals: Sequence[str] = ()) -> None:
    """One analysis of one task, written with its parameters."""
    if analysis not in ANALYSES:
        raise ValueError(f"analysis must be one of {ANALYSES}")
    func = load(spark, study, "func", task)
    if analysis == "pca":
        scores, loadings = components(func)
        write_result(loadings, f"{out}/{task}_pca", task=task, analysis=analysis, tr=tr)
        spark.createDataFrame(scores).write.mode("overwrite").parquet(f"{out}/{task}_pca/scores")
    elif analysis == "dlm_event":
        write_result(event_response(func, load(spark, study, "events", task), tr), f"{out}/{task}_events", task=task, analysis=analysis, tr=tr)
    else:
        for s in signals:
            write_result(physio_response(func, load(spark, study, "physio", task), s), f"{out}/{task}_{s}", task=task, analysis=analysis, tr=tr, signal=s)
