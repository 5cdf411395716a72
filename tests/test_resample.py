"""Polyphase resampling against a zero-stuffed convolution."""

import numpy as np
import pytest

from spindrift.functions import kernels as K
from spindrift.operators import signal as P


def plain(x, up, down):
    g = np.gcd(up, down)
    up, down = up // g, down // g
    h = K.polyphase_filter(up, down)
    z = np.zeros(len(x) * up)
    z[::up] = x
    full = np.convolve(z, h)
    n = -(-len(x) * up // down)
    at = np.arange(n) * down + len(h) // 2
    return np.append(full, np.zeros(max(0, at[-1] + 1 - len(full))))[at]


@pytest.mark.parametrize("up, down", [(1, 1), (1, 20), (3, 2), (7, 11), (50, 3), (4, 6)])
def test_equals_convolution(up, down):
    x = np.random.default_rng(up).normal(size=257)
    assert np.allclose(K.polyphase(x, up, down), plain(x, up, down), rtol=0, atol=1e-9)


def test_a_tone_keeps_its_shape_and_what_is_too_fast_goes():
    t = np.arange(4000) / 400
    slow, fast = np.sin(2 * np.pi * 3 * t), np.sin(2 * np.pi * 60 * t)
    y = K.resample(slow + fast, 400, 50)
    assert len(y) == 500 and np.abs(y - np.sin(2 * np.pi * 3 * np.arange(500) / 50))[30:-30].max() < 0.01
    assert len(K.resample(np.zeros(0), 400, 50)) == 0


@pytest.mark.parametrize("up, down", [(2, 3), (5, 2), (1, 7)])
def test_chunks_equal_the_whole(spark, up, down):
    r = np.random.default_rng(3)
    given = {"a": r.normal(size=1000), "b": r.normal(size=129), "c": np.array([2.0])}
    rows = [(k, i, float(v)) for k, x in given.items() for i, v in enumerate(x)]
    got = P.resampled(spark.createDataFrame(rows, "run string, ix int, x double").repartition(5), "x", "run", "ix", up, down, chunk=64).collect()
    for k, x in given.items():
        y = sorted((q.ix, q.x) for q in got if q.run == k)
        assert [i for i, _ in y] == list(range(-(-len(x) * up // down)))
        assert np.allclose([v for _, v in y], K.polyphase(x, up, down), rtol=0, atol=1e-9)


def test_edges(spark):
    none = spark.createDataFrame([], "run string, ix int, x double")
    assert P.resampled(none, "x", "run", "ix", 1, 2).collect() == []
    with pytest.raises(ValueError):
        P.resampled(none, "x", "run", "ix", 0, 2)
    with pytest.raises(Exception, match="gaps"):
        P.resampled(spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], none.schema), "x", "run", "ix", 1, 2).collect()
