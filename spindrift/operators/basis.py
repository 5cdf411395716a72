"""Spline bases over lags, and the projection of a series on them."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spline_df(n_lags: int, tr: float, knots_per_second: float, n_knots: int | None = None) -> int:
    """Columns of a basis: as asked for, else three or more by the lags' duration."""
    return n_knots or max(3, ceil(n_lags * tr * knots_per_second))


def _knots(x: np.ndarray, inner: int) -> np.ndarray:
    return np.percentile(np.unique(x), np.linspace(0, 100, inner + 2)[1:-1]) if inner else np.zeros(0)


def natural_spline(x: Sequence[float], df: int, knots: Sequence[float] | None = None) -> np.ndarray:
    """A natural cubic spline through ``df`` knots: each column is the spline that is 1 at its own knot, 0 at the others.

    Columns sum to 1; straight lines are reproduced, also beyond the outer knots.
    """
    x = np.asarray(x, float)
    k = np.sort(np.concatenate([[x.min(), x.max()], _knots(x, df - 2) if knots is None else np.asarray(knots, float)]))
    n, h = len(k), np.diff(k)
    second = np.zeros((n, n))
    if n > 2:
        d, b = np.zeros((n - 2, n)), np.zeros((n - 2, n - 2))
        for i in range(n - 2):
            d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
            b[i, i] = (h[i] + h[i + 1]) / 3
            if i:
                b[i, i - 1] = b[i - 1, i] = h[i] / 6
        second[1:-1] = np.linalg.solve(b, d)
    j = np.clip(np.searchsorted(k, x, side="right") - 1, 0, n - 2)
    left, right, w = k[j + 1] - x, x - k[j], h[j]
    cubic_left = np.where(x > k[-1], 0.0, left**3 / w)
    cubic_right = np.where(x < k[0], 0.0, right**3 / w)
    eye = np.eye(n)
    out = (left / w)[:, None] * eye[j] + (right / w)[:, None] * eye[j + 1]
    return out + ((cubic_left - w * left) / 6)[:, None] * second[j] + ((cubic_right - w * right) / 6)[:, None] * second[j + 1]


def b_spline(x: Sequence[float], df: int, knots: Sequence[float] | None = None, degree: int = 3, bounds: tuple[float, float] | None = None) -> np.ndarray:
    """A B-spline basis without its first (intercept) column, so rows sum to 1 less that column."""
    x = np.asarray(x, float)
    lo, hi = bounds or (x.min(), x.max())
    inner = _knots(x, df - degree) if knots is None else np.asarray(knots, float)
    t = np.concatenate([[lo] * (degree + 1), np.sort(inner), [hi] * (degree + 1)])
    at = np.clip(x, lo, hi)
    level = np.array([(at >= a) & ((at < b) | ((b == hi) & (at == hi) & (a < b))) for a, b in zip(t, t[1:])], float).T
    for p in range(1, degree + 1):
        up = np.zeros((len(x), len(t) - 1 - p))
        for i in range(up.shape[1]):
            if t[i + p] > t[i]:
                up[:, i] += (at - t[i]) / (t[i + p] - t[i]) * level[:, i]
            if t[i + p + 1] > t[i + 1]:
                up[:, i] += (t[i + p + 1] - at) / (t[i + p + 1] - t[i + 1]) * level[:, i + 1]
        level = up
    return level[:, 1:]


BASES = {"cr": natural_spline, "bs": b_spline}


def basis_matrix(lags: Sequence[int], df: int, kind: str = "cr", knots: Sequence[float] | None = None) -> np.ndarray:
    """Lags by columns. ``knots``, if given, win over ``df``."""
    if kind not in BASES:
        raise ValueError(f"kind must be one of {sorted(BASES)}")
    lags = list(lags)
    if knots is not None:
        df = len(knots) + (2 if kind == "cr" else 3)
    return BASES[kind](lags, df, knots)


def basis_table(spark: SparkSession, lags: Sequence[int], df: int, kind: str = "cr", knots: Sequence[float] | None = None) -> DataFrame:
    """``lag, k, w``: as many rows as lags times columns, whatever the data."""
    lags = list(lags)
    m = basis_matrix(lags, df, kind, knots)
    rows = [(int(lag), k, float(w)) for lag, row in zip(lags, m) for k, w in enumerate(row)]
    return spark.createDataFrame(rows, "lag int, k int, w double")


def project(series: DataFrame, basis: DataFrame, by: Sequence[str], t: str, value: str, n_lags: int | None = None) -> DataFrame:
    """``by, t, k, v``: v = sum over lags of w(lag, k) x(t - lag).

    With ``n_lags`` only times that have all lags stay; without it missing samples count as 0. Each sample
    names the times that it adds to, and the sums combine before the shuffle. The basis is small (lags by
    columns, independent of the data), which is why it is broadcast.
    """
    by = list(by)
    added = series.select(*by, F.col(t).alias("_t"), F.col(value).alias("_x")).crossJoin(F.broadcast(basis))
    added = added.select(*by, (F.col("_t") + F.col("lag")).alias(t), "k", (F.col("_x") * F.col("w")).alias("_v"))
    out = added.groupBy(*by, t, "k").agg(F.sum("_v").alias("v"), F.count("*").alias("_n"))
    if n_lags is not None:
        out = out.where(F.col("_n") == n_lags)
    return out.drop("_n").join(series.select(*by, t), [*by, t], "left_semi")


def interactions(events: DataFrame, physio: DataFrame, by: Sequence[str], t: str) -> DataFrame:
    """Products of every event column with every physio column at each time, event-major ``col``.

    Inputs are long: ``by, t, k, x``.
    """
    by = list(by)
    n = physio.agg((F.max("k") + 1).alias("_n"))
    a = events.select(*by, t, F.col("k").alias("_i"), F.col("x").alias("_a"))
    b = physio.select(*by, t, F.col("k").alias("_j"), F.col("x").alias("_b"))
    return a.join(b, [*by, t]).crossJoin(F.broadcast(n)).select(*by, t, (F.col("_i") * F.col("_n") + F.col("_j")).alias("col"), (F.col("_a") * F.col("_b")).alias("x"))
