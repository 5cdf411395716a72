"""Randomised components against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import components as C
from spindrift.operators import linear as L


def low_rank(n, m, seed=1):
    r = np.random.default_rng(seed)
    u, v = np.linalg.qr(r.normal(size=(n, 12)))[0], np.linalg.qr(r.normal(size=(m, 12)))[0]
    return (u * 10.0 * 0.7 ** np.arange(12)) @ v.T + 0.01 * r.normal(size=(n, m)) / np.sqrt(n) + 3


def frame(spark, x, parts=20):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>").repartition(parts)


@pytest.mark.parametrize("centre", ["columns", "rows", None])
@pytest.mark.parametrize("exact", [10, 400])
def test_subspace_is_the_exact_one(spark, centre, exact):
    x = low_rank(500, 300)
    c = x - x.mean(0) if centre == "columns" else x - x.mean(1, keepdims=True) if centre == "rows" else x
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    found = C.decompose(frame(spark, x), "v", 5, centre=centre, exact=exact)
    assert np.abs(found.values - s[:5]).max() < 1e-6 * s[0]
    assert np.abs(found.vectors @ found.vectors.T - vt[:5].T @ vt[:5]).max() < 1e-6
    assert (found.vectors[np.abs(found.vectors).argmax(0), np.arange(5)] > 0).all()
    again = C.decompose(frame(spark, x, 7), "v", 5, centre=centre, exact=exact)
    assert np.abs(again.vectors - found.vectors).max() < 1e-6


def test_tree_of_triangles(spark):
    x = np.random.default_rng(2).normal(size=(400, 6)) * [9, 5, 1, 1, 0.1, 1e-6]
    df = frame(spark, x, 40).select("v")
    r = C.tall_qr(df, 6, 6, lambda a: a)
    assert np.allclose(r.T @ r, x.T @ x)


def test_few_rows_and_wrong_ones(spark):
    none = spark.createDataFrame([], "k int, v array<double>")
    assert C.decompose(none, "v", 3).vectors.size == 0
    one = C.decompose(frame(spark, np.array([[3.0, 4.0]]), 3), "v", 3, centre=None)
    assert np.allclose(one.values, [5]) and np.allclose(one.vectors.ravel(), [0.6, 0.8])
    for wrong in ([(1, [1.0, 2.0]), (2, [1.0])], [(1, [1.0, 2.0]), (2, None)], [(1, [1.0, 2.0]), (2, [1.0, None])]):
        with pytest.raises(Exception, match="2 numbers"):
            C.decompose(spark.createDataFrame(wrong, "k int, v array<double>"), "v", 1)
    with pytest.raises(ValueError):
        C.decompose(none, "v", 1, centre="x")


def test_wide_region_stays_in_tasks(spark):
    """3,000 voxels by 40 times: the seed is the first component's course, with the mean's sign."""
    r = np.random.default_rng(5)
    course, weight = r.normal(size=40), r.normal(size=3000) + 0.3
    x = np.outer(course, weight) + 0.1 * r.normal(size=(40, 3000)) + 5
    m = spark.range(40 * 3000).select((F.col("id") % 40).alias("t"), F.floor(F.col("id") / 40).alias("voxel"))
    values = spark.createDataFrame([(t, x[t].tolist()) for t in range(40)], "t long, row array<double>")
    m = m.join(values, "t").select("t", "voxel", F.get("row", F.col("voxel").cast("int")).alias("x"))
    got = {q.t: q.s for q in L.roi_seed(m, m.select("voxel"), "pca").collect()}
    c = x - x.mean(0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    wanted = u[:, 0] * s[0]
    wanted *= np.sign(wanted @ (c.mean(1)))
    assert np.allclose([got[t] for t in range(40)], wanted, atol=1e-6 * s[0])
