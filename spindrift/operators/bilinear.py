"""The bilinear model as one object: maps scaled, series standardised and centred, fitted, read back and reconstructed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import linear as L
from .series import zscore
from .stats import map_norms


class BilinearModel:
    """Y by maps S to time courses Z = Y S'(SS' + pI)^-1, and Z by the design X to coefficients A' = (X'X + pI)^-1 X'Z.

    ``normalise`` scales each map by its ``l2`` norm or its largest size (``maxabs``), ``none`` leaves it; ``standardise``
    z-scores each column of X and of Y; ``centre`` takes off each column's mean, which reconstructions add back.
    Long forms: design ``(t, k, x)``, outcomes ``(t, voxel, x)``, maps ``(map, voxel, x)``.
    """

    def __init__(self, penalty: float = 0.01, normalise: str = "l2", standardise: bool = True, centre: bool = False, eps: float = 1e-12):
        if penalty < 0 or normalise not in ("l2", "maxabs", "none"):
            raise ValueError("need penalty >= 0 and normalise l2, maxabs or none")
        self.penalty, self.normalise, self.standardise, self.centre, self.eps = penalty, normalise, standardise, centre, eps
        self._fitted: tuple[DataFrame, DataFrame] | None = None

    def _prepared(self, rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame | None]:
        """``t, column, x`` after standardising and centring, and the means that centring took off."""
        rows = rows.select("t", column, "x")
        if self.standardise:
            rows = zscore(rows, "x", [column]).select("t", column, F.col("z").alias("x"))
        if not self.centre:
            return rows, None
        means = cut(rows.groupBy(column).agg(F.avg("x").alias("_mean")))
        return rows.join(means, column).select("t", column, (F.col("x") - F.col("_mean")).alias("x")), means

    def fit(self, design: DataFrame, outcomes: DataFrame, maps: DataFrame) -> BilinearModel:
        self.maps = cut(map_norms(maps.select("map", "voxel", "x"), self.normalise, self.eps))
        x, self.x_means = self._prepared(design, "k")
        y, self.y_means = self._prepared(outcomes, "voxel")
        courses, coefficients = L.bilinear(x, y, self.maps, self.penalty)
        self._fitted = cut(courses), cut(coefficients)
        return self

    def _of_fit(self, k: int) -> DataFrame:
        if self._fitted is None:
            raise ValueError("the model is not fitted")
        return self._fitted[k]

    @property
    def time_courses(self) -> DataFrame:
        """``t, map, z``."""
        return self._of_fit(0)

    @property
    def coefficients(self) -> DataFrame:
        """``k, map, a``."""
        return self._of_fit(1)

    def _outside(self, courses: DataFrame) -> DataFrame:
        y = L.reconstruct(courses, self.maps)
        if self.y_means is None:
            return y
        return y.join(self.y_means, "voxel").select("t", "voxel", (F.col("y") + F.col("_mean")).alias("y"))

    def predicted(self) -> DataFrame:
        """``t, voxel, y``: the fitted time courses times the maps."""
        return self._outside(self.time_courses)

    def reconstruct(self, design: DataFrame) -> DataFrame:
        """``t, voxel, y`` from any regressors ``(t, k, x)``: less the fit's means, times coefficients and maps, plus the outcomes' means."""
        x = design.select("t", "k", "x")
        a = self.coefficients
        if self.x_means is not None:
            x = x.join(self.x_means, "k").select("t", "k", (F.col("x") - F.col("_mean")).alias("x"))
        z = L.cross_products(x, a.withColumnRenamed("a", "x"), ["k"], "t", "map").withColumnsRenamed({"i": "t", "j": "map", "s": "z"})
        return self._outside(z)

    def project(self, basis: DataFrame) -> DataFrame:
        """``lag, map, y``: the coefficients of one trial on its lag basis ``(lag, k, w)``."""
        return L.project_trial(self.coefficients, basis)
