"""The bilinear model against NumPy, its options and its errors."""

import numpy as np
import pytest

from spindrift.operators import linear as L
from spindrift.operators.bilinear import BilinearModel


def long(spark, m, i, j):
    return spark.createDataFrame([(int(a), int(b), float(v)) for (a, b), v in np.ndenumerate(m)], f"{i} int, {j} int, x double")


@pytest.mark.parametrize("options", [{"standardise": False, "centre": True, "normalise": "maxabs"}, {"penalty": 0.5, "centre": True}, {"standardise": False, "normalise": "none", "penalty": 0.0}])
def test_equals_numpy(spark, options):
    r = np.random.default_rng(2)
    x, s, y, new = r.normal(size=(30, 2)) + 1, r.normal(size=(3, 12)), r.normal(size=(30, 12)) + 5, r.normal(size=(7, 2))
    model = BilinearModel(**options).fit(long(spark, x, "t", "k"), long(spark, y, "t", "voxel"), long(spark, s, "map", "voxel"))
    p = options.get("penalty", 0.01)
    n = options.get("normalise", "l2")
    scaled = s / (np.linalg.norm(s, axis=1) if n == "l2" else np.abs(s).max(1) if n == "maxabs" else np.ones(3))[:, None]
    if options.get("standardise", True):
        x, y = (x - x.mean(0)) / x.std(0), (y - y.mean(0)) / y.std(0)
    mx, my = (x.mean(0), y.mean(0)) if options.get("centre") else (0 * x[0], 0 * y[0])
    z = (y - my) @ scaled.T @ np.linalg.inv(scaled @ scaled.T + p * np.eye(3))
    a = np.linalg.inv((x - mx).T @ (x - mx) + p * np.eye(2)) @ (x - mx).T @ z
    assert np.allclose(L.to_matrix(model.time_courses, "t", "map", "z"), z)
    assert np.allclose(L.to_matrix(model.coefficients, "k", "map", "a"), a)
    assert np.allclose(L.to_matrix(model.predicted(), "t", "voxel", "y"), z @ scaled + my)
    assert np.allclose(L.to_matrix(model.reconstruct(long(spark, new, "t", "k")), "t", "voxel", "y"), (new - mx) @ a @ scaled + my)


def test_errors():
    for wrong in ({"penalty": -1.0}, {"normalise": "x"}):
        with pytest.raises(ValueError):
            BilinearModel(**wrong)
    for name in ("time_courses", "coefficients"):
        with pytest.raises(ValueError, match="not fitted"):
            getattr(BilinearModel(), name)
