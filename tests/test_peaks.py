"""Peaks in chunks against a plain version over the whole series."""

import numpy as np
import pytest

from spindrift.operators import peaks as P


def plain(x, height=None, plateau=None, distance=None, prominence=None, width=None, wlen=None, rel=0.5):
    tops, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                tops.append(((i + j) // 2, j - i + 1))
            i = j
        i += 1
    tops = [(p, n) for p, n in tops if (plateau is None or plateau[0] <= n <= plateau[1]) and (height is None or x[p] >= height)]
    if distance:
        kept, left = set(), dict(tops)
        for p in sorted(left, key=lambda p: (-x[p], -p)):
            if all(abs(p - k) >= np.ceil(distance) for k in kept):
                kept.add(p)
        tops = [t for t in tops if t[0] in kept]
    out = []
    for p, n in tops:
        lo, hi = (max(0, p - wlen // 2), min(len(x) - 1, p + wlen // 2)) if wlen else (0, len(x) - 1)
        a, lows = p, []
        m = x[p]
        while a >= lo and x[a] <= x[p]:
            m, a = min(m, x[a]), a - 1
        lows.append(m)
        a, m = p, x[p]
        while a <= hi and x[a] <= x[p]:
            m, a = min(m, x[a]), a + 1
        lows.append(m)
        pr = x[p] - max(lows)
        level = max(x[p] - pr * rel, max(lows))
        a = p
        while a > lo and level < x[a]:
            a -= 1
        left = a + ((level - x[a]) / (x[a + 1] - x[a]) if x[a] < level else 0)
        a = p
        while a < hi and level < x[a]:
            a += 1
        right = a - ((level - x[a]) / (x[a - 1] - x[a]) if x[a] < level else 0)
        if (prominence is None or pr >= prominence) and (width is None or width[0] <= right - left <= width[1]):
            out.append((p, x[p], n, pr, left, right))
    return out


def series():
    r = np.random.default_rng(7)
    t = np.arange(700)
    return {
        "noise": r.normal(size=700),
        "steps": np.round(np.sin(t / 9) * 3 + r.normal(size=700) * 0.4),
        "rise": t * 0.01 + (t % 2) * 0.5,
        "fall": -t * 0.01 + (t % 3),
        "flat": np.repeat([0.0, 1.0, 0.0, 2.0, 2.0, 1.0, 3.0, 0.0], [60, 130, 7, 40, 1, 90, 200, 3]),
        "short": np.array([1.0, 2.0]),
        "spike": np.concatenate([[9.0], t[:300] * 0.001 + (t[:300] % 2) * 0.1, [9.5, 0]]),
    }


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(k, i, float(v)) for k, x in series().items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "run string, ix int, x double").repartition(6).cache()


@pytest.mark.parametrize(
    "given",
    [{}, {"height": 0.5, "distance": 39.5, "rel": 1.0}, {"plateau": (2, 100), "prominence": 0.3}, {"wlen": 31, "width": (1.5, 20), "rel": 0.7}],
)
def test_equals_a_plain_version(frame, given):
    named = {{"plateau": "plateau_size", "rel": "rel_height"}.get(k, k): v for k, v in given.items()}
    got = P.find_peaks(frame, "x", "run", "ix", chunk=16, **named).collect()
    for run, x in series().items():
        wanted = plain(x, **given)
        those = sorted((r.ix, r.height, r.plateau_size, r.prominence, r.left, r.right) for r in got if r.run == run)
        assert [w[0] for w in wanted] == [g[0] for g in those], run
        assert np.allclose(np.array(wanted, float).reshape(-1, 6), np.array(those, float).reshape(-1, 6)), run
    assert got


def test_errors(spark):
    gap = spark.createDataFrame([("a", 0, 1.0), ("a", 2, 1.0)], "run string, ix int, x double")
    with pytest.raises(Exception, match="gaps"):
        P.find_peaks(gap, "x", "run", "ix")
    with pytest.raises(Exception, match="missing"):
        P.find_peaks(spark.createDataFrame([("a", 0, None)], "run string, ix int, x double"), "x", "run", "ix")
    for wrong in ({"rel_height": 1.5}, {"distance": 0.5}, {"wlen": 1}):
        with pytest.raises(ValueError):
            P.find_peaks(gap, "x", "run", "ix", **wrong)
    none = spark.createDataFrame([], "run string, ix int, x double")
    assert P.find_peaks(none, "x", "run", "ix", distance=3).collect() == []


def cap_frames(spark):
    """Two patterns that take turns in 12 bursts of a quiet signal."""
    r = np.random.default_rng(9)
    x = r.normal(size=(120, 20)) * 0.1
    for n, t in enumerate(range(5, 120, 10)):
        x[t, :10 if n % 2 else 20] += 3 + 0.01 * n
    return x, spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t int, v array<double>")


@pytest.mark.parametrize(
    "options",
    [{"method": "zscore", "threshold": 1.0}, {"method": "absolute", "threshold": 1.0, "distance": 5, "prominence": 0.5, "width": (0.5, 9), "standardise": True}, {"method": "absolute", "threshold": 1.0, "local_maxima": False, "reducer": "median", "mask": [True] * 9 + [False] * 11}],
)
def test_co_activation_options(spark, options):
    from spindrift.operators import cluster

    x, frames = cap_frames(spark)
    maps, found = cluster.co_activation(frames, "t", "v", 2, **options)
    got = {r.t: r.cluster for r in found.collect()}
    assert len(got) == 120 and sorted(t for t, c in got.items() if c >= 0) == list(range(5, 120, 10))
    assert np.array(maps).shape == (2, 20)
    if "standardise" not in options:
        assert {got[t] for t in range(5, 120, 20)} != {got[t] for t in range(15, 120, 20)} and all(len({got[t] for t in range(s, 120, 20)}) == 1 for s in (5, 15))


def test_co_activation_errors(spark):
    from spindrift.operators import cluster

    x, frames = cap_frames(spark)
    for wrong, said in (({"method": "x"}, "method"), ({"reducer": "x"}, "reducer"), ({"mask": [False] * 20}, "no place"), ({"mask": [True]}, "length"), ({"method": "absolute", "threshold": 99.0}, "fewer")):
        with pytest.raises(Exception, match=said):
            cluster.co_activation(frames, "t", "v", 2, **wrong)
    top, bound = cluster.global_peaks(frames.selectExpr("t", "v[0] AS gs"), "absolute", 1.0, most=3)
    assert sorted(r.t for r in top.collect()) == sorted((5 + 10 * np.argsort(x[5::10, 0])[-3:]).tolist()) and bound == 1.0
