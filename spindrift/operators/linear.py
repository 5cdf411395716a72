"""Linear models of thousands of outcomes on one small design.

Sums over time are Spark aggregations; only matrices as large as the design is wide reach the driver.
Long forms: designs ``(run, t, k, x)``, outcomes ``(run, t, voxel, x)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from .components import decompose, projected, time_scores

#: Cells of a design that may be sent to every task (8 bytes each).
DESIGN_CELLS = 4_000_000


def gram(rows: DataFrame, vector: str, moments: bool = False) -> DataFrame:
    """``i, j, s``: sum over rows of v[i] v[j], upper half too. One partial matrix a task, then summed.

    ``moments`` adds the row (-1, j) of plain sums and (-1, -1), the row count.
    """

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(float)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            n = len(total)
            i, j = np.indices((n, n))
            i, j = np.where(i == n - 1, -1, i), np.where(j == n - 1, -1, j)
            keep = (j >= 0) & (i >= 0) | (moments & (i == -1))
            yield pd.DataFrame({"i": i[keep], "j": j[keep], "s": total[keep]})

    return rows.select(vector).mapInPandas(part, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))


def to_matrix(df: DataFrame, i: str = "i", j: str = "j", s: str = "s") -> np.ndarray:
    """A small long matrix on the driver."""
    got = df.select(i, j, s).toPandas()
    out = np.zeros((int(got[i].max()) + 1, int(got[j].max()) + 1)) if len(got) else np.zeros((0, 0))
    out[got[i], got[j]] = got[s]
    return out


def cross_products(a: DataFrame, b: DataFrame, on: Sequence[str], i: str, j: str, x: str = "x") -> DataFrame:
    """``i, j, s``: sum over the shared index of a's and b's columns, by one join and one combined sum."""
    left = a.select(*on, F.col(i).alias("i"), F.col(x).alias("_a"))
    right = b.select(*on, F.col(j).alias("j"), F.col(x).alias("_b"))
    return left.join(right, list(on)).groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("s"))


def ridge_inverse(m: np.ndarray, penalty: float) -> np.ndarray:
    """(M + penalty I)^-1; without a penalty the pseudo-inverse."""
    return np.linalg.inv(m + penalty * np.eye(len(m))) if penalty else np.linalg.pinv(m)


def small_table(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i int, j int, w double")


def ridge(design: DataFrame, outcomes: DataFrame, penalty: float, on: Sequence[str] = ("run", "t")) -> DataFrame:
    """``voxel, k, beta`` of a ridge regression without intercept: (X'X + penalty I)^-1 X'Y, all voxels at once."""
    xtx = to_matrix(cross_products(design, design, on, "k", "k"))
    inverse = small_table(design.sparkSession, ridge_inverse(xtx, penalty))
    xty = cross_products(design, outcomes, on, "k", "voxel")
    solved = xty.withColumnRenamed("i", "_k").join(F.broadcast(inverse.withColumnsRenamed({"i": "k", "j": "_k"})), "_k")
    return solved.groupBy(F.col("j").alias("voxel"), "k").agg(F.sum(F.col("s") * F.col("w")).alias("beta"))


def ridge_series(design: DataFrame, voxels: DataFrame, penalty: float, most: int = DESIGN_CELLS) -> DataFrame:
    """``voxel, k, beta`` as ``ridge`` gives them, from voxel-major rows ``(run, voxel, ts)``, ``ts`` an array over ``t`` from 0.

    Each run's design times (X'X + penalty I)^-1 is sent to the tasks, where a row gives its share of the voxel's
    coefficients at once; only these shares, a few numbers a row, are shuffled and summed over runs. Times that the
    design lacks count nothing. A design of more than ``most`` cells isn't sent: then rows meet it by key, in long form.
    """
    design = cut(design.select("run", F.col("t").cast("int").alias("t"), F.col("k").cast("int").alias("k"), "x"))
    if design.limit(most + 1).count() > most:
        return ridge(design, voxels.select("run", "voxel", F.posexplode("ts").alias("t", "x")), penalty, ["run", "t"])
    inverse = ridge_inverse(to_matrix(cross_products(design, design, ["run", "t"], "k", "k")), penalty)
    weights = {}
    for run, g in design.toPandas().groupby("run", sort=False):
        x = np.zeros((int(g["t"].max()) + 1, len(inverse)))
        x[g["t"], g["k"]] = g["x"]
        weights[run] = x @ inverse
    sent = design.sparkSession.sparkContext.broadcast(weights)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run, g in batch.groupby("run", sort=False):
                w = sent.value.get(run)
                for n, same in g.groupby(g["ts"].map(len), sort=False) if w is not None else ():
                    m = min(n, len(w))
                    b = np.stack(same["ts"].to_numpy())[:, :m].astype(float) @ w[:m]
                    yield pd.DataFrame({"voxel": np.repeat(same["voxel"].to_numpy(), b.shape[1]), "k": np.tile(np.arange(b.shape[1], dtype="int32"), len(b)), "beta": b.ravel()})

    kind = voxels.schema["voxel"].dataType.simpleString()
    parts = voxels.select("run", "voxel", "ts").mapInPandas(shares, f"voxel {kind}, k int, beta double")
    return parts.groupBy("voxel", "k").agg(F.sum("beta").alias("beta"))


def predict(coefficients: DataFrame, basis: DataFrame, row: str = "lag") -> DataFrame:
    """``row, voxel, y``: a small basis ``(row, k, w)`` times coefficients, a broadcast join and one sum."""
    return coefficients.join(F.broadcast(basis), "k").groupBy(row, "voxel").agg(F.sum(F.col("beta") * F.col("w")).alias("y"))


def seed_map(matrix: DataFrame, seed: DataFrame, metric: str = "correlation", fisher: bool = False, eps: float = 1e-12) -> DataFrame:
    """``voxel, r``: each voxel with ``seed(t, s)``. Correlations are clipped to +-1; without variance null.

    A seed without variance is an error. A covariance over one sample is 0.
    """
    if metric not in ("correlation", "covariance"):
        raise ValueError("metric must be correlation or covariance")
    both = matrix.join(seed.select("t", "s"), "t")
    m = both.groupBy("voxel").agg(
        F.covar_pop("x", "s").alias("c"), F.covar_samp("x", "s").alias("cs"), F.stddev_pop("x").alias("sx"), F.stddev_pop("s").alias("ss")
    )
    if metric == "covariance":
        return m.select("voxel", F.coalesce("cs", F.lit(0.0)).alias("r"))
    ok = F.assert_true(F.col("ss") > eps, F.lit("the seed has no variance"))
    r = F.when((F.col("sx") > eps) & ok.isNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c") / F.nullif(F.col("sx") * F.col("ss"), F.lit(0.0)))))
    if fisher:
        r = F.when(r.isNotNull(), F.atanh(F.greatest(F.lit(-1 + 1e-7), F.least(F.lit(1 - 1e-7), r))))
    return m.select("voxel", r.alias("r"))


def roi_seed(matrix: DataFrame, roi: DataFrame, strategy: str = "mean") -> DataFrame:
    """``t, s``: the mean of the region's voxels, or its first principal component with the mean's sign."""
    inside = matrix.join(roi.select("voxel").distinct(), "voxel", "left_semi")
    mean = inside.groupBy("t").agg(F.avg("x").alias("s"))
    if strategy == "mean":
        return mean
    if strategy != "pca":
        raise ValueError("strategy must be mean or pca")
    times = inside.select("t").distinct().withColumn("_k", F.row_number().over(Window.orderBy("t")) - 1)  # a frame each
    n = times.count()
    series = inside.join(F.broadcast(times), "t").groupBy("voxel").agg(F.sort_array(F.collect_list(F.struct("_k", "x"))).alias("_x"), F.avg("x").alias("_m"))
    held = F.map_from_entries("_x")  # a frame that a voxel lacks has its mean
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda k: F.coalesce(held[k], F.col("_m")))
    ts = F.when(F.size("_x") == n, F.transform("_x", lambda e: e["x"])).otherwise(filled)
    found = decompose(cut(series.select(ts.alias("ts"))), "ts", 1, centre="rows")
    first = (found.vectors * found.values)[:, 0] if len(found.values) else np.zeros(0)
    w = inside.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(first)], "_k int, s double")
    pc = times.join(F.broadcast(w), "_k").select("t", "s")
    sign = pc.join(mean.withColumnRenamed("s", "_m"), "t").agg(F.covar_pop("s", "_m")).first()[0]
    return pc.withColumn("s", F.col("s") * F.lit(-1.0 if sign is not None and sign < 0 else 1.0))


def pca(rows: DataFrame, key: str, vector: str, k: int, n_iter: int = 10) -> tuple[DataFrame, pd.DataFrame]:
    """``(key, component, score)`` and the loadings with explained variance, of rows that are samples.

    Components are those of the centred columns, scores the uncentred rows times them (``components.decompose``).
    """
    found = decompose(rows, vector, k, n_iter)
    loadings = pd.DataFrame(found.vectors * found.values / np.sqrt(max(found.rows - 1, 1)))
    loadings.attrs["explained_variance"] = found.values**2 / max(found.rows - 1, 1) / max(len(found.vectors), 1)
    return projected(rows, key, vector, found.vectors), loadings


def pca_time(voxels: DataFrame, key: str, ts: str, k: int, n_iter: int = 10) -> tuple[pd.DataFrame, DataFrame]:
    """Scores ``(t, component, score)`` on the driver and loadings ``(key, component, loading)``, from a row per voxel.

    As ``pca`` of the matrix on its side, where times are the samples: each voxel is centred, the scores are of
    the uncentred matrix, and the largest entry of a component's time course is positive.
    """
    found = decompose(voxels, ts, k, n_iter, centre="rows")
    course = time_scores(voxels, ts, found)
    t, c = np.indices(course.shape)
    scores = pd.DataFrame({"t": t.ravel(), "component": c.ravel(), "score": course.ravel()})
    n = max(len(found.vectors) - 1, 1)
    scores.attrs["explained_variance"] = found.values**2 / n / max(found.rows, 1)
    return scores, projected(voxels, key, ts, found.vectors / np.sqrt(n), "rows", "loading")


def bilinear(design: DataFrame, outcomes: DataFrame, maps: DataFrame, penalty: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Map time courses Z = Y S'(SS' + pI)^-1 and coefficients A' = (X'X + pI)^-1 X'Z.

    ``outcomes(t, voxel, x)``, ``maps(map, voxel, x)``, ``design(t, k, x)``; returns ``(t, map, z)`` and
    ``(k, map, a)``. Only map-by-map and column-by-column matrices are inverted.
    """
    spark = maps.sparkSession
    sst = to_matrix(cross_products(maps, maps, ["voxel"], "map", "map"))
    inverse = small_table(spark, ridge_inverse(sst, penalty))
    yst = cross_products(outcomes, maps, ["voxel"], "t", "map")
    z = yst.withColumnsRenamed({"i": "t", "j": "_m"}).join(F.broadcast(inverse.withColumnsRenamed({"i": "_m", "j": "map"})), "_m")
    z = z.groupBy("t", "map").agg(F.sum(F.col("s") * F.col("w")).alias("z"))
    xtx = to_matrix(cross_products(design, design, ["t"], "k", "k"))
    xtz = cross_products(design, z.withColumnRenamed("z", "x"), ["t"], "k", "map")
    a = xtz.withColumnsRenamed({"i": "_k", "j": "map"}).join(F.broadcast(small_table(spark, ridge_inverse(xtx, penalty)).withColumnsRenamed({"i": "k", "j": "_k"})), "_k")
    return z, a.groupBy("k", "map").agg(F.sum(F.col("s") * F.col("w")).alias("a"))


def reconstruct(z: DataFrame, maps: DataFrame) -> DataFrame:
    """``t, voxel, y`` = Z S."""
    return cross_products(z.withColumnRenamed("z", "x"), maps, ["map"], "t", "voxel").withColumnsRenamed({"i": "t", "j": "voxel", "s": "y"})


def project_trial(coefficients: DataFrame, basis: DataFrame) -> DataFrame:
    """``lag, map, y``: trial coefficients ``(k, map, a)`` on a fine lag basis ``(lag, k, w)``."""
    return coefficients.join(F.broadcast(basis), "k").groupBy("lag", "map").agg(F.sum(F.col("a") * F.col("w")).alias("y"))
