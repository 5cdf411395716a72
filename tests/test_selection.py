"""Exact percentiles by distributed selection."""

import math
import random

import numpy as np
import pytest

from spindrift.operators import selection as S
from spindrift.operators import stats as A

AT = (0, 0.01, 0.25, 0.5, 0.9, 0.999, 1)


def values():
    r = random.Random(6)
    return {
        ("a", 1): [r.gauss(0, 1) for _ in range(4000)],
        ("a", None): [float(r.randrange(3)) for _ in range(3000)],
        (None, 1): [7.0] * 2500,
        ("b", 2): [math.exp(r.gauss(0, 40)) * r.choice((-1, 1)) for _ in range(3000)],
        ("b", 3): np.repeat([1.0, 1.0 + 2**-52, 5e-324, -0.0], [1, 2000, 5, 900]).tolist(),
        ("c", 1): [3.0, 1.0, 2.0],
        ("c", 2): [-4.0],
    }


@pytest.mark.parametrize("few", [40, 1000, S.FEW])
def test_equals_numpy(spark, few):
    given = values()
    rows = [(k, j, x, "other") for (k, j), xs in given.items() for x in xs] + [("c", 3, None, ""), ("c", 4, float("nan"), ""), ("c", 1, None, ""), ("c", 1, float("nan"), "")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, x double, lo string").repartition(6)
    got = {(r.k, r.j): r.q for r in S.exact_quantiles(df, "x", ["k", "j"], AT, few).collect()}
    assert set(got) == set(given)
    for key, xs in given.items():
        wanted = np.quantile(xs, AT)
        assert np.allclose(got[key], wanted, rtol=1e-12, atol=0), key


def test_one_group_of_all_rows(spark, monkeypatch):
    """More than two rounds, and no task that holds more than the bound."""
    monkeypatch.setattr(S, "PLACES", 8)
    df = spark.range(50_000).selectExpr("(id * 7919) % 50000 AS x", "id AS rank").repartition(8)
    q = S.exact_quantiles(df, "x", [], (0.1, 0.5, 0.99), few=20).first().q
    assert q == pytest.approx([4999.9, 24999.5, 49499.01])


def test_empty_and_arguments(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert S.exact_quantiles(none, "x", ["k"], (0.5,)).collect() == [] == S.exact_quantiles(none, "x", [], (0.5,)).collect()
    for wrong in ((), (1.5,), (-0.1,)):
        with pytest.raises(ValueError):
            S.exact_quantiles(none, "x", ["k"], wrong)


def test_statistics_use_it(spark, monkeypatch):
    df = spark.createDataFrame([(k % 3, float(k * 37 % 1000)) for k in range(3000)], "k int, x double")
    before = [sorted(map(tuple, f(df).collect())) for f in (lambda d: A.box_stats(d, "x", ["k"]), lambda d: A.intensity_bounds(d, "x", by=["k"]), lambda d: A.fit_summary(d, "x", 900.0, ["k"]))]
    narrow = S.exact_quantiles
    monkeypatch.setattr(A, "exact_quantiles", lambda *a: narrow(*a, few=30))
    after = [sorted(map(tuple, f(df).collect())) for f in (lambda d: A.box_stats(d, "x", ["k"]), lambda d: A.intensity_bounds(d, "x", by=["k"]), lambda d: A.fit_summary(d, "x", 900.0, ["k"]))]
    assert all(np.allclose(np.array(a), np.array(b)) for a, b in zip(before, after))
