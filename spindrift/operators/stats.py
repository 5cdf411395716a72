"""Summary operators over long matrices (``t, voxel, x``) and labelled values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import exact_quantiles


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def check_percentiles(low: float, high: float) -> None:
    if not 0 <= low < high <= 100:
        raise ValueError("need 0 <= low < high <= 100")


def global_signal(matrix: DataFrame, how: str = "mean", mask: DataFrame | None = None) -> DataFrame:
    """``t, gs``: mean or median over voxels (of ``mask(voxel)`` if given) at each time."""
    if how not in ("mean", "median"):
        raise ValueError("how must be mean or median")
    m = matrix if mask is None else matrix.join(mask.select("voxel").distinct(), "voxel", "left_semi")
    return m.groupBy("t").agg((F.avg("x") if how == "mean" else F.median("x")).alias("gs"))


def quantiles(df: DataFrame, value: str, by: Sequence[str], at: Sequence[float], accuracy: int | None = None) -> DataFrame:
    """``by`` and ``q``, an array of quantiles: exact whatever the size of a group, or with ``accuracy`` (rank error 1 / accuracy) a sketch's."""
    if accuracy is None:
        return exact_quantiles(df, value, by, at)
    return df.groupBy(*by).agg(F.percentile_approx(value, [float(v) for v in at], accuracy).alias("q"))


def with_quantiles(groups: DataFrame, quantiles_: DataFrame, by: Sequence[str]) -> DataFrame:
    """``groups`` with ``q`` of each, null for groups that have none; null keys meet null keys."""
    named = quantiles_.select(*[F.col(c).alias(f"_q{c}") for c in by], "q")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_q{c}"))
    return groups.join(named, same, "left").drop(*[f"_q{c}" for c in by])


def box_stats(df: DataFrame, value: str, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Quartiles, mean, and whiskers: the extreme values within 1.5 interquartile ranges of the box."""
    by = list(by)
    q = quantiles(df, value, by, (0.25, 0.5, 0.75), accuracy)
    q = q.select(*by, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    x = F.col(value)
    return df.join(q, by).groupBy(*by, "q1", "median", "q3").agg(
        F.avg(value).alias("mean"), F.min(F.when(x >= F.col("q1") - 1.5 * iqr, x)).alias("low"), F.max(F.when(x <= F.col("q3") + 1.5 * iqr, x)).alias("high")
    )


def intensity_bounds(df: DataFrame, value: str, low: float = 1.0, high: float = 99.0, by: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Percentile bounds of the finite values; degenerate bounds are opened a little."""
    check_percentiles(low, high)
    p = quantiles(df.where(finite(F.col(value))), value, by, (low / 100, high / 100), accuracy)
    a, b = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return p.select(*by, a.alias("vmin"), F.when(b <= a, a + 1e-6).otherwise(b).alias("vmax"))


def difference_rms(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Root mean square of the second differences of each curve; not finite ones are left out, none gives 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value)
    tagged = df.withColumn("_d", d)
    ok = F.when(finite(F.col("_d")), F.col("_d") * F.col("_d"))
    return tagged.groupBy(*by).agg(F.coalesce(F.sqrt(F.avg(ok)), F.lit(0.0)).alias("rms"))


def normalised_rmse(df: DataFrame, observed: str, fitted: str, by: Sequence[str]) -> DataFrame:
    """Root mean squared residual over the median absolute observation, finite cells only; a zero scale gives null."""
    o, f = F.col(observed), F.col(fitted)
    used = df.where(finite(o) & finite(f)).withColumn("_abs", F.abs(o))
    out = used.groupBy(*by).agg(F.sqrt(F.avg((o - f) * (o - f))).alias("_r"))
    out = with_quantiles(out, exact_quantiles(used, "_abs", list(by), (0.5,)), list(by))
    return out.select(*by, (F.col("_r") / F.nullif(F.get("q", F.lit(0)), F.lit(0.0))).alias("nrmse"))


def fit_summary(df: DataFrame, value: str, cap: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of missing values, share at the cap (within one part in 10**5), median and 99th percentile."""
    x, by = F.col(value), list(by)
    ok = finite(x)
    shares = df.groupBy(*by).agg(
        F.avg(F.when(ok, 0.0).otherwise(1.0)).alias("nan_fraction"), F.avg(F.when(ok, F.when(F.abs(x - cap) <= 1e-5 * cap, 1.0).otherwise(0.0))).alias("clip_fraction")
    )
    both = with_quantiles(shares, exact_quantiles(df.where(ok), value, by, (0.5, 0.99)), by)
    return both.withColumns({"median": F.get("q", F.lit(0)), "p99": F.get("q", F.lit(1))}).drop("q")


def column_moments(matrix: DataFrame) -> DataFrame:
    """Mean and population deviation of each column."""
    return matrix.groupBy("voxel").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def map_norms(maps: DataFrame, how: str = "l2", eps: float = 1e-12) -> DataFrame:
    """Each map scaled by its L2 norm or its largest absolute value, not under ``eps``; ``none`` leaves it."""
    if how not in ("l2", "maxabs", "none"):
        raise ValueError("how must be l2, maxabs or none")
    if how == "none":
        return maps
    norm = F.sqrt(F.sum(F.col("x") * F.col("x"))) if how == "l2" else F.max(F.abs("x"))
    n = maps.groupBy("map").agg(F.greatest(norm, F.lit(eps)).alias("_n"))
    return maps.join(n, "map").withColumn("x", F.col("x") / F.col("_n")).drop("_n")


def bounding_box(points: DataFrame, columns: Sequence[str], pad: float = 0.0) -> DataFrame:
    """Smallest and largest of each coordinate, ``pad`` of the span wider on both sides."""
    got = points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    span = lambda c: (F.col(f"max_{c}") - F.col(f"min_{c}")) * pad
    return got.select(*[x for c in columns for x in ((F.col(f"min_{c}") - span(c)).alias(f"min_{c}"), (F.col(f"max_{c}") + span(c)).alias(f"max_{c}"))])


def index_lists(df: DataFrame, label: str, index: str) -> DataFrame:
    """Per label (0 is no label) its indices in order."""
    return df.where(F.col(label) != 0).groupBy(label).agg(F.sort_array(F.collect_list(index)).alias("indices"))


def face_values(faces: DataFrame, values: DataFrame) -> DataFrame:
    """Mean of the vertices of each face; ``faces(face, vertices)``, ``values(vertex, x)``."""
    each = faces.select("face", F.explode("vertices").alias("vertex"))
    return each.join(values, "vertex").groupBy("face").agg(F.avg("x").alias("x"))


def face_levels(faces: DataFrame, low: Column, high: Column) -> DataFrame:
    """Face values on a scale of 0 to 1 between two bounds, clipped; not finite ones are null."""
    wide = F.when(high <= low, low + 1e-6).otherwise(high)
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") - low) / (wide - low)))
    return faces.withColumn("level", F.when(finite(F.col("x")), level))


def draws(df: DataFrame, value: str, key: Sequence[str], n: int = 25, seed: int = 0) -> DataFrame:
    """``draw, x``: ``n`` finite values drawn with replacement, each the row with the least hash of that draw.

    One aggregation with partials whatever ``n``; ``key`` tells rows apart, rows that share it share their draws.
    No finite value gives no row.
    """
    x = F.col(value)
    rows = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    one = rows.agg(*[F.min_by(value, F.xxhash64(*key, F.lit(seed), F.lit(d))).alias(f"d{d}") for d in range(n)])
    return one.select(F.posexplode(F.array(*[f"d{d}" for d in range(n)])).alias("draw", "x")).where("x is not null")
