"""Event regressors: each trial type's onsets through a lag basis on a fine grid, read at the frame times."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import cubic, uniform_slopes
from .basis import basis_matrix, spline_df
from .events import max_duration
from .series import zscore

#: Seconds of the fine grid, and of the box that stands for an event whatever its duration.
GRID, IMPULSE = 0.01, 0.5


def impulses(onsets: np.ndarray, n: int, grid: float, width: float) -> np.ndarray:
    """A running sum of +1 at onsets and -1 after the width; coinciding onsets are set, not added."""
    at = lambda s: np.ceil(np.asarray(s) / grid - 1e-9).astype(int)
    return counted_impulses(at(onsets), at(np.asarray(onsets) + width), np.ones(len(onsets), int), n)


def counted_impulses(first: np.ndarray, last: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    """``impulses`` from the fine grid's samples and how many events have each pair of them."""
    x = np.zeros(n)
    x[np.clip(first, 0, n - 1)] = 1
    np.subtract.at(x, np.clip(last, 0, n - 1), times)
    return np.cumsum(x)


def fine_samples(frames: np.ndarray, grid: float) -> int:
    return int(round((frames[-1] + 1) / grid)) + 1


def regressors(onsets: np.ndarray, frames: np.ndarray, weights: np.ndarray, grid: float = GRID, width: float = IMPULSE) -> np.ndarray:
    """One column per basis column at the frame times: the box train's lags times the basis, cubic between grid points."""
    return box_regressors(impulses(onsets, fine_samples(frames, grid), grid, width), frames, weights, grid)


def box_regressors(box: np.ndarray, frames: np.ndarray, weights: np.ndarray, grid: float = GRID) -> np.ndarray:
    """``regressors`` of a box train on the fine grid."""
    n = len(box)
    size = 1 << (n + len(weights) - 1).bit_length()
    fine = np.fft.irfft(np.fft.rfft(box, size)[:, None] * np.fft.rfft(weights, size, axis=0), size, axis=0)[:n]
    at = np.asarray(frames, float) / grid
    if n < 7:
        return np.stack([cubic(np.arange(n), fine[:, c], at) for c in range(weights.shape[1])], axis=1)
    out = np.empty((len(at), weights.shape[1]))
    slopes = uniform_slopes(7)
    for a in range(0, len(at), 1 << 14):  # a cubic through the nearest points of the fine grid, many frames at once
        f = at[a : a + (1 << 14)]
        lo = np.clip(np.rint(f) - 3, 0, n - 7).astype(int)
        y = fine[lo[:, None] + np.arange(7)]
        m = np.einsum("ij,fjc->fic", slopes, y)
        j = np.clip(np.floor(f - lo), 0, 5).astype(int)
        s, row = (f - lo - j)[:, None], np.arange(len(f))
        out[a : a + len(f)] = (1 + 2 * s) * (1 - s) ** 2 * y[row, j] + s * (1 - s) ** 2 * m[row, j] + s**2 * (3 - 2 * s) * y[row, j + 1] + s**2 * (s - 1) * m[row, j + 1]
    return out


def event_design(series: DataFrame, events: DataFrame, tr: float, knots_per_second: float = 0.3, n_knots: int | None = None, kind: str = "cr", extend: float = 15.0, duration: float | None = None, reference: float = 0.5, grid: float | None = None) -> tuple[DataFrame, dict]:
    """``(run, t, k, x)``, z-scored over all runs, and the shape of each trial type's basis.

    ``series(run, t, ...)`` gives the frames, ``events(run, trial_type, onset, duration)`` the onsets in
    seconds. Trial types are in name order, so columns are the same in every run. Events are first counted by
    (run, trial type, sample of the fine grid); a group is one type in one run and holds as many rows as the
    run has samples at most, however many events there are.
    """
    grid = grid or (GRID if tr < 10 else tr / 100)
    longest = {r["trial_type"]: r["max_duration"] for r in max_duration(events).orderBy("trial_type").collect()}
    shapes, first = {}, 0
    for name in sorted(longest):
        seconds = duration if duration is not None else longest[name] + extend
        n = int(np.ceil(seconds / grid))
        df = spline_df(n, grid, knots_per_second, n_knots)
        shapes[name] = {"first": first, "df": df, "n": n, "grid": grid, "kind": kind, "seconds": seconds}
        first += df
    weights = {name: basis_matrix(range(s["n"]), s["df"], kind) for name, s in shapes.items()}
    frames = series.groupBy("run").agg((F.max("t") + 1).alias("n"))
    sample = lambda s: F.greatest(F.ceil(s / grid - 1e-9), F.lit(0))
    beyond = F.ceil(((F.col("n") + reference) * tr + 1 + reference) / grid)
    on = events.join(frames, "run").select("run", "trial_type", *[F.least(sample(s), beyond).alias(c) for c, s in (("first", F.col("onset")), ("last", F.col("onset") + IMPULSE))])
    counted = on.groupBy("run", "trial_type", "first", "last").agg(F.count("*").alias("times"))
    listed = counted.groupBy("run", "trial_type").agg(*[F.collect_list(F.col(c)).alias(c) for c in ("first", "last", "times")])
    names = events.sparkSession.createDataFrame([(name,) for name in shapes], "trial_type string")
    per_type = frames.crossJoin(F.broadcast(names)).join(listed, ["run", "trial_type"], "left")

    def work(batches):
        for batch in batches:
            for run, name, n, first, last, times in zip(*[batch[c] for c in ("run", "trial_type", "n", "first", "last", "times")]):
                s, at = shapes[name], np.linspace(reference, (n - 1 + reference) * tr, int(n))
                x = np.zeros((int(n), s["df"]))
                if first is not None:
                    x = box_regressors(counted_impulses(first, last, times, fine_samples(at, grid)), at, weights[name], grid)
                t, k = np.indices(x.shape)
                yield pd.DataFrame({"run": run, "t": t.ravel(), "k": k.ravel() + s["first"], "x": x.ravel()})

    kind_of_run = series.schema["run"].dataType.simpleString()
    design = per_type.select("run", "trial_type", "n", "first", "last", "times").mapInPandas(work, f"run {kind_of_run}, t long, k int, x double")
    return zscore(design, "x", ["k"]).select("run", "t", "k", F.col("z").alias("x")), shapes


def evaluate_events(coefficients: DataFrame, shapes: dict, delta: float = 1.0) -> DataFrame:
    """``trial_type, time, voxel, y``: a single event's predicted response, on the basis as it is (not z-scored)."""
    spark = coefficients.sparkSession
    rows = []
    for name, s in shapes.items():
        m = basis_matrix(range(s["n"]), s["df"], s["kind"])
        for time in np.arange(0, s["seconds"], delta):
            at = min(int(round(time / s["grid"])), s["n"] - 1)
            rows += [(name, float(time), s["first"] + k, float(w)) for k, w in enumerate(m[at])]
    basis = spark.createDataFrame(rows, "trial_type string, time double, k int, w double")
    return coefficients.join(F.broadcast(basis), "k").groupBy("trial_type", "time", "voxel").agg(F.sum(F.col("beta") * F.col("w")).alias("y"))
