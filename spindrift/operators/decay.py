"""Time-varying decay fits over echoes, and the sweep over their two penalties."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..sources.shared import cut
from .selection import exact_quantiles, order_statistics
from .stats import difference_rms, fit_summary, normalised_rmse, with_quantiles


def check_echo_times(times: Sequence[float]) -> np.ndarray:
    """Milliseconds, finite, positive, rising, two at least."""
    te = np.asarray(times, float)
    if len(te) < 2 or not np.isfinite(te).all() or (te <= 0).any() or (np.diff(te) <= 0).any():
        raise ValueError("echo times must be two or more rising positive numbers")
    if te.max() < 1:
        raise ValueError("echo times must be in milliseconds")
    return te


#: How far apart coupled unknowns are: log S0 and rate take turns over time, and a penalty spans two times.
BAND = 4


@lru_cache(64)
def _factor(times: tuple[float, ...], n: int, penalty0: float, penalty1: float) -> np.ndarray:
    """Lower Cholesky factor of the normal matrix for log S0 and rate at ``n`` times, each smooth by its second difference.

    Row ``i`` holds the entries ``BAND`` to 0 places left of the diagonal, so memory and time grow with ``n``.
    """
    te = np.array(times)
    smooth = np.zeros((n, 3))  # second differences squared, by distance in time
    for i in range(n - 2):
        smooth[i : i + 3, 0] += 1, 4, 1
        smooth[i + 1 : i + 3, 1] += -2, -2
        smooth[i + 2, 2] += 1
    a = np.zeros((2 * n, BAND + 1))
    a[0::2, ::2] = penalty0 * smooth[:, ::-1]
    a[1::2, ::2] = penalty1 * smooth[:, ::-1]
    a[0::2, BAND] += len(te)
    a[1::2, BAND] += (te * te).sum()
    a[1::2, BAND - 1] = -te.sum()
    rows = np.zeros((2 * n + BAND, BAND + 1))
    for i in range(2 * n):
        for k in range(BAND + 1):  # the entry in column i - BAND + k
            above = rows[i + k]  # that column's own row, four rows of zeros first
            x = a[i, k] - rows[i + BAND, :k] @ above[BAND - k : BAND]
            rows[i + BAND, k] = np.sqrt(x) if k == BAND else x / above[BAND] if i + k >= BAND else 0.0
    return rows[BAND:]


def _solve(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The unknowns ``(2 n, voxel)`` for right sides ``b`` of that shape."""
    n = len(factor)
    y = np.zeros((n + BAND, b.shape[1]))
    for i in range(n):
        y[i + BAND] = (b[i] - factor[i, :BAND] @ y[i : i + BAND]) / factor[i, BAND]
    x = np.zeros((n + BAND, b.shape[1]))
    below = np.vstack([factor, np.zeros((BAND, BAND + 1))])
    for i in range(n - 1, -1, -1):
        x[i] = (y[i + BAND] - below[i + np.arange(1, BAND + 1), BAND - np.arange(1, BAND + 1)] @ x[i + 1 : i + 1 + BAND]) / factor[i, BAND]
    return x[:n]


def fit_series(y: np.ndarray, times: Sequence[float], penalty0: float, penalty1: float, least: float = 1e-6, rescale: float = 100.0, cap: float = 500.0):
    """S0 and T2* (ms, at most ``cap``; NaN where the decay isn't positive) of series ``(voxel, echo, time)``."""
    te = np.asarray(times, float) / rescale
    n = y.shape[2]
    logs = np.log(np.maximum(y, least))
    b = np.empty((2 * n, len(y)))
    b[0::2], b[1::2] = logs.sum(1).T, -(te[None, :, None] * logs).sum(1).T
    x = _solve(_factor(tuple(te), n, penalty0, penalty1), b).T
    s0, rate = np.exp(x[:, 0::2]), x[:, 1::2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t2 = np.where(rate > 0, np.minimum(cap, rescale / rate), np.nan)
    return s0, t2


def fit_decay(voxels: DataFrame, echo_times: Sequence[float], penalty0: float = 3.0, penalty1: float = 1.0, rescale: float = 10.0, cap: float = 500.0, least: float = 1e-6, keep: Sequence[str] = ()) -> DataFrame:
    """``voxel_id, n_good, s0, t2star`` (arrays over time), after columns to ``keep``, from ``voxel_id, n_good, series`` (echo by time).

    Where the decay isn't positive T2* is null. Only the first ``n_good`` echoes are used; under two, or with a number that isn't finite, the voxel is
    not fitted (null). One factor per echo count and length serves all voxels of a batch. No shuffle.
    """
    te = check_echo_times(echo_times)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s0, t2 = [None] * len(batch), [None] * len(batch)
            cubes = [np.stack([np.asarray(e, float) for e in s]) for s in batch["series"]]
            groups: dict[tuple[int, int], list[int]] = {}
            for k, (c, g) in enumerate(zip(cubes, batch["n_good"])):
                g = min(int(g), len(te))
                if g >= 2 and np.isfinite(c[:g]).all():
                    groups.setdefault((g, c.shape[1]), []).append(k)
            for (g, _), members in groups.items():
                a, b = fit_series(np.stack([cubes[k][:g] for k in members]), te[:g], penalty0, penalty1, least, rescale, cap)
                for k, x, y in zip(members, a, b):
                    s0[k], t2[k] = x, y
            yield batch.drop(columns="series").assign(s0=s0, t2star=t2)

    rows = voxels.select(*keep, F.col("voxel_id").cast("long"), F.col("n_good").cast("int"), "series")
    schema = StructType([*rows.schema.fields[:-1], StructField("s0", ArrayType(DoubleType())), StructField("t2star", ArrayType(DoubleType()))])
    return rows.mapInPandas(work, schema)


def good_echoes(voxels: DataFrame, fraction: float = 1 / 3) -> DataFrame:
    """``n_good``: the last echo whose mean over time is at least that share of the first one's."""
    mean = F.transform("series", lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e))
    marked = F.transform(mean, lambda m, i: F.when(m >= F.get(mean, F.lit(0)) * fraction, i + 1).otherwise(0))
    return voxels.withColumn("n_good", F.array_max(marked).cast("int"))


def adaptive_mask(voxels: DataFrame, threshold: int = 2, percent: float = 33.0, by: Sequence[str] = ()) -> DataFrame:
    """``voxels(series, ...)`` with ``n_good``: how many echoes of a voxel have signal, 0 if fewer than ``threshold``.

    The limits of a volume (of each ``by``) come from one voxel: of those whose first echo has a mean over time other
    than 0, the one at that percentile (the next higher value; of equal ones the one with the largest sum of means). An
    echo has signal if its mean is over a third of that voxel's in size. Two passes: one finds the percentile exactly,
    whatever the number of voxels, and the limits, one number an echo; the other compares, map-only but for meeting
    the limits. A volume without such a voxel has 0 everywhere. ``voxels`` is read several times.
    """
    mean = F.transform("series", lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e))
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("_"))
    means = cut(voxels.select(key.alias("_k"), mean.alias("m")).withColumn("x", F.get("m", F.lit(0))).where("x <> 0"))
    sizes = means.groupBy("_k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("inside"))
    wanted = sizes.withColumn("rank", F.ceil(F.lit(percent / 100) * (F.col("inside") - 1)))
    at = order_statistics(means.select("_k", "x"), wanted).select("_k", "x")
    total = F.aggregate("m", F.lit(0.0), lambda a, x: a + x)
    limits = means.join(F.broadcast(at), ["_k", "x"]).groupBy("_k").agg(F.max_by("m", total).alias("_least"))  # a row a volume
    met = voxels.withColumn("_k", key).join(F.broadcast(limits), "_k", "left")
    n = F.aggregate(F.zip_with(mean, "_least", lambda m, least: (F.abs(m) > least / 3).cast("int")), F.lit(0), lambda a, x: a + x)
    return met.withColumn("n_good", F.when(n >= threshold, n).otherwise(0)).drop("_k", "_least")


def fitted_signal(fits: DataFrame, voxels: DataFrame, echo_times: Sequence[float]) -> DataFrame:
    """``voxel_id, echo, t, observed, fitted`` of the used echoes."""
    both = voxels.select("voxel_id", "series").join(fits.where("s0 is not null"), "voxel_id")
    te = F.array(*[F.lit(float(t)) for t in echo_times])
    each = both.select("voxel_id", "n_good", "s0", "t2star", F.posexplode("series").alias("echo", "ts")).where("echo < n_good")
    each = each.select("voxel_id", "echo", F.get(te, F.col("echo")).alias("te"), "s0", "t2star", F.posexplode("ts").alias("t", "observed"))
    return each.select("voxel_id", "echo", "t", "observed", (F.get("s0", F.col("t")) * F.exp(-F.col("te") / F.get("t2star", F.col("t")))).alias("fitted"))


def sweep(voxels: DataFrame, echo_times: Sequence[float], grid0: Sequence[float], grid1: Sequence[float], cap: float = 500.0, rescale: float = 100.0) -> DataFrame:
    """One row of fit measures per penalty pair, best first; pairs are a handful, voxels are spread."""
    out = None
    for p0 in grid0:
        for p1 in grid1:
            fits = cut(fit_decay(voxels, echo_times, p0, p1, rescale, cap))  # fitted once, measured several times
            long = fits.where("t2star is not null").select("voxel_id", F.posexplode("t2star").alias("t", "x"))
            rough = difference_rms(fits.where("s0 is not null").select("voxel_id", F.posexplode("s0").alias("t", "x")).withColumn("x", F.ln("x")), "x", ["voxel_id"], ["t"])
            one = with_quantiles(fit_summary(long, "x", cap), exact_quantiles(rough, "rms", [], (0.5,)), []).withColumn("log_s0_roughness", F.get("q", F.lit(0)))
            one = one.crossJoin(normalised_rmse(fitted_signal(fits, voxels, echo_times).withColumn("all", F.lit(0)), "observed", "fitted", ["all"]).select("nrmse"))
            one = one.select(F.lit(float(p0)).alias("lambda0"), F.lit(float(p1)).alias("lambda1"), "nrmse", "log_s0_roughness", "nan_fraction", "clip_fraction", F.col("median").alias("median_t2star"), F.col("p99").alias("p99_t2star"))
            out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("nrmse").asc_nulls_last(), F.col("clip_fraction").asc_nulls_last(), F.col("nan_fraction").asc_nulls_last())


def sample_voxels(voxels: DataFrame, n: int, seed: int = 0, least_echoes: int = 2) -> DataFrame:
    """At most ``n`` eligible voxels, the same ones each time, by id."""
    return voxels.where(F.col("n_good") >= least_echoes).orderBy(F.xxhash64("voxel_id", F.lit(seed))).limit(n).orderBy("voxel_id")
