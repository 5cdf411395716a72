"""Seeds of k-means."""

import numpy as np
import pytest

from spindrift.operators import cluster


def points(spark, parts):
    r = np.random.default_rng(3)
    middles = r.normal(size=(6, 8)) * 6
    x = np.concatenate([m + r.normal(size=(60, 8)) for m in middles])
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>").repartition(parts)


def plain_lloyd(x, n, seed):
    r = np.random.default_rng(seed)
    c = [x[r.integers(len(x))]]
    while len(c) < n:
        d = ((x[:, None] - np.array(c)) ** 2).sum(2).min(1)
        c.append(x[r.choice(len(x), p=d / d.sum())])
    c = np.array(c)
    for _ in range(100):
        near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(n)])
    return ((x[:, None] - c) ** 2).sum(2).min(1).sum()


def test_seeds_repeat_and_are_good(spark):
    x, df = points(spark, 5)
    seeds = cluster.parallel_seeds(df, "v", 6)
    again = cluster.parallel_seeds(points(spark, 9)[1], "v", 6)
    assert np.allclose(seeds, again, rtol=0, atol=1e-9)
    got = cluster.inertia(df, "v", cluster.lloyd(df, "v", seeds, 50))
    assert got <= np.mean([plain_lloyd(x, 6, s) for s in range(5)]) * 1.001


def test_few_points(spark):
    some = spark.createDataFrame([([0.0],), ([0.0],), ([4.0],)], "v array<double>")
    assert sorted(cluster.parallel_seeds(some, "v", 2)) == [[0.0], [4.0]]
    for df in (some, some.limit(0)):
        with pytest.raises(ValueError, match="distinct"):
            cluster.parallel_seeds(df, "v", 3)
