"""Co-activation patterns: peaks of the global signal, clustered by Lloyd's rounds from fixed centres."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .peaks import Limits, find_peaks, numbered
from .selection import exact_quantiles


def squared_distance(vector: str, centre: list[float]) -> Column:
    pairs = F.zip_with(vector, F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def assign(points: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """``points`` with ``cluster`` (the nearest centre, the first of equals) and its squared ``distance``."""
    each = [F.struct(squared_distance(vector, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centres)]
    return points.withColumn("_b", F.array_min(F.array(*each))).select(*points.columns, F.col("_b.cluster").alias("cluster"), F.col("_b.distance").alias("distance"))


def centres_of(assigned: DataFrame, vector: str) -> DataFrame:
    """``cluster, pos, c``: the mean of each position of each cluster, combined before the shuffle."""
    return assigned.select("cluster", F.posexplode(vector).alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("c"))


def lloyd(points: DataFrame, vector: str, start: list[list[float]], rounds: int = 300, tolerance: float = 1e-6) -> list[list[float]]:
    """Centres after Lloyd's rounds; an empty cluster keeps its centre. Only centres reach the driver."""
    centres = np.array(start, float)
    for _ in range(rounds):
        new = centres.copy()
        for r in centres_of(assign(points, vector, centres.tolist()), vector).collect():  # clusters x positions
            new[r["cluster"], r["pos"]] = r["c"]
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if moved <= tolerance:
            break
    return centres.tolist()


def inertia(points: DataFrame, vector: str, centres: list[list[float]]) -> float:
    """The sum of squared distances to the nearest centres."""
    return float(assign(points, vector, centres).agg(F.coalesce(F.sum("distance"), F.lit(0.0))).first()[0])


def _reduced(candidates: np.ndarray, weights: np.ndarray, n: int, seed: int, tries: int = 8) -> np.ndarray:
    """``n`` centres of a few weighted candidates: k-means++ and Lloyd's rounds, the best of some tries."""
    best, least = candidates[:n], np.inf
    for k in range(tries):
        r = np.random.default_rng(seed + k)
        c = [candidates[r.choice(len(candidates), p=weights / weights.sum())]]
        while len(c) < n:
            d = weights * ((candidates[:, None] - np.array(c)) ** 2).sum(2).min(1)
            c.append(candidates[r.choice(len(candidates), p=d / d.sum()) if d.sum() > 0 else len(c) % len(candidates)])
        c = np.array(c)
        for _ in range(50):
            near = ((candidates[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([np.average(candidates[near == j], axis=0, weights=weights[near == j]) if (near == j).any() else c[j] for j in range(n)])
            if np.allclose(new, c):
                break
            c = new
        cost = float((weights * ((candidates[:, None] - c) ** 2).sum(2).min(1)).sum())
        if cost < least:
            best, least = c, cost
    return best


def parallel_seeds(points: DataFrame, vector: str, n: int, rounds: int = 5, factor: float = 2.0, seed: int = 0) -> list[list[float]]:
    """First centres for Lloyd's rounds by k-means||: each round draws points in proportion to their squared distance, ``factor * n`` of them about.

    Points are drawn by keyed hashes of their vectors, so seeds repeat whatever the order or number of tasks. Only
    the drawn points, some ``rounds * factor * n`` of them, and how many points are nearest to each reach the driver,
    where ``n`` of them are made. Fewer distinct points than ``n`` is an error.
    """
    named = points.select(F.col(vector).alias("v")).withColumn("_h", F.xxhash64("v", F.lit(seed)))
    first = named.orderBy("_h").select("v").first()
    chosen = [list(map(float, first[0]))] if first else []
    for k in range(rounds if chosen else 0):
        far = assign(named.select("v"), "v", chosen)
        cost = far.agg(F.sum("distance")).first()[0]
        if not cost:
            break
        u = F.pmod(F.xxhash64("v", F.lit(seed), F.lit(k + 1)), F.lit(1 << 30)) / float(1 << 30)
        drawn = far.where(u < F.col("distance") * (factor * n / cost)).select("v").distinct().orderBy(F.xxhash64("v")).collect()
        chosen += [list(map(float, r[0])) for r in drawn]
    if len(chosen) < n:
        spare = assign(named.select("v"), "v", chosen).where("distance > 0").select("v").distinct().orderBy(F.xxhash64("v")).limit(n - len(chosen)).collect() if chosen else []
        chosen += [list(map(float, r[0])) for r in spare]
    if len(chosen) < n:
        raise ValueError("fewer distinct points than centres")
    counts = dict(tuple(r) for r in assign(named.select("v"), "v", chosen).groupBy("cluster").count().collect())
    return _reduced(np.array(chosen), np.array([float(counts.get(k, 0)) for k in range(len(chosen))]), n, seed).tolist()


def occurrences(frames: DataFrame, peaks: DataFrame) -> DataFrame:
    """Every frame's cluster, -1 where there is no peak."""
    return frames.select("t").join(peaks.select("t", "cluster"), "t", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


def global_peaks(
    signal: DataFrame, method: str = "zscore", threshold: float = 2.0, distance: int = 0, most: int | None = None, local_maxima: bool = True,
    prominence: Limits = None, width: Limits = None, wlen: int | None = None, rel_height: float = 0.5, plateau_size: Limits = None,
) -> tuple[DataFrame, float]:
    """``t, gs`` of the peaks of ``signal(t, gs)``, and the threshold that was used.

    ``zscore`` compares the standardised signal with the threshold, ``percentile`` the signal with its percentile of
    that name, ``absolute`` with the number itself. Without ``local_maxima`` every frame at or above it counts. Of
    more than ``most`` peaks the highest stay (earlier ones of equals). Frames are numbered in order of ``t``.
    """
    if method not in ("zscore", "percentile", "absolute"):
        raise ValueError("method must be zscore, percentile or absolute")
    if method == "percentile":
        found = exact_quantiles(signal, "gs", [], [threshold / 100]).first()
        score, bound = F.col("gs"), float(found.q[0]) if found else 0.0
    else:
        m = signal.agg(F.avg("gs"), F.stddev_pop("gs")).first() if method == "zscore" else None
        score, bound = (F.col("gs") - F.lit(m[0])) / F.nullif(F.lit(m[1]), F.lit(0.0)) if m and m[0] is not None else F.col("gs"), float(threshold)
    scored = signal.select("t", "gs", score.alias("_s"))
    if not local_maxima:
        return scored.where(F.col("_s") >= bound).select("t", "gs"), bound
    rows = numbered(scored.where("_s is not null"), ["t"]).withColumn("_run", F.lit("all"))
    at = find_peaks(rows, "_s", "_run", "ix", bound, plateau_size, distance or None, prominence, width, wlen, rel_height)
    if most is not None:
        at = at.orderBy(F.desc("height"), "ix").limit(most)
    return rows.join(at.select("ix"), "ix", "left_semi").select("t", "gs"), bound


def co_activation(
    frames: DataFrame, key: str, vector: str, n: int, rounds: int = 300, method: str = "percentile", threshold: float = 75.0, mask: Sequence[bool] | None = None,
    reducer: str = "mean", standardise: bool = False, eps: float = 1e-12, start: str = "parallel", seed: int = 0, **limits,
) -> tuple[list[list[float]], DataFrame]:
    """Maps of ``n`` patterns and the occurrence of each over all frames.

    The global signal is each frame's mean or median (``reducer``) over all places or those of ``mask``; its peaks
    are as ``global_peaks`` takes them, with ``limits`` passed on. With ``standardise`` a peak's vector loses its own
    mean and spread. The first centres are ``parallel_seeds``, or with ``start="highest"`` the ``n`` highest peaks. Fewer peaks than patterns is an error, and so is
    a mask of another length than the vectors or without a place.
    """
    if reducer not in ("mean", "median") or start not in ("parallel", "highest"):
        raise ValueError("reducer must be mean or median, start parallel or highest")
    v = F.col(vector)
    if mask is not None:
        if not any(mask):
            raise ValueError("the mask has no place")
        fits = F.assert_true(F.size(v) == len(mask), F.lit("the mask is of another length than a vector"))
        v = F.filter(F.when(fits.isNull(), v), lambda x, i: F.get(F.array(*[F.lit(bool(b)) for b in mask]), i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    s = F.array_sort(v)
    middle = (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    gs = total(v) / F.size(v) if reducer == "mean" else middle
    g = frames.select(F.col(key).alias("t"), F.col(vector).alias("v"), gs.alias("gs"))
    # the peaks are found on times and means alone; only theirs are the vectors that follow
    at, _ = global_peaks(g.select("t", "gs"), method, threshold, **limits)
    top = g.join(at.select("t"), "t", "left_semi")
    if standardise:
        mean = total(F.col("v")) / F.size("v")
        top = top.withColumn("_m", mean).withColumn("_sd", F.sqrt(total(F.transform("v", lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / F.size("v")))
        top = top.withColumn("v", F.transform("v", lambda x: (x - F.col("_m")) / (F.col("_sd") + eps))).drop("_m", "_sd")
    top = cut(top)
    first = [r["v"] for r in top.orderBy(F.col("gs").desc(), "t").limit(n).collect()]
    if len(first) < n:
        raise ValueError("fewer peaks than patterns")
    centres = lloyd(top, "v", parallel_seeds(top, "v", n, seed=seed) if start == "parallel" else first, rounds)
    return centres, occurrences(g, assign(top, "v", centres))
