"""Sampling of volumes at coordinates.

Points and volumes are both large, and the size that Spark guesses for one built by exploding rows is that of the
file behind it, many times too small; so these joins are sorted ones, never a broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest(points: DataFrame, volume: DataFrame) -> DataFrame:
    """``points(id, x, y, z)`` with the value of the voxel each is in; outside the volume null."""
    at = points.withColumns({c: F.bround(n).cast("int") for c, n in (("i", "x"), ("j", "y"), ("k", "z"))})
    return at.join(volume.select("i", "j", "k", F.col("v").alias("value")).hint("merge"), ["i", "j", "k"], "left").select("id", "value")


def linear(points: DataFrame, volume: DataFrame) -> DataFrame:
    """Trilinear: each point asks its eight corners by key and sums their weights; a missing corner gives null."""
    base = points.withColumns({c: F.floor(n).cast("int") for c, n in (("i0", "x"), ("j0", "y"), ("k0", "z"))})
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    each = base.select("id", "x", "y", "z", "i0", "j0", "k0", F.explode(corners).alias("o"))
    part = lambda p, o, n: F.when(F.col(o) == 1, F.col(p) - F.col(n)).otherwise(1 - (F.col(p) - F.col(n)))
    w = part("x", "o.a", "i0") * part("y", "o.b", "j0") * part("z", "o.c", "k0")
    each = each.select("id", (F.col("i0") + F.col("o.a")).alias("i"), (F.col("j0") + F.col("o.b")).alias("j"), (F.col("k0") + F.col("o.c")).alias("k"), w.alias("w")).where("w > 0")
    met = each.join(volume.select("i", "j", "k", "v").hint("merge"), ["i", "j", "k"], "left")
    got = met.groupBy("id").agg(F.sum(F.col("w") * F.col("v")).alias("value"), F.max(F.col("v").isNull()).alias("_gone"))
    return got.select("id", F.when(~F.col("_gone"), F.col("value")).alias("value"))


def _filtered(lines: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the last axis, mirrored at both ends: one recursion forward and one back."""
    n = lines.shape[-1]
    if n == 1:
        return lines.copy()
    z = np.sqrt(3) - 2
    k = np.arange(n)
    powers = z**k
    powers[1 : n - 1] += z ** (2 * n - 2 - k[1 : n - 1])
    c = 6 * lines
    c[..., 0] = (c * powers).sum(-1) / (1 - z ** (2 * n - 2))
    for i in range(1, n):
        c[..., i] += z * c[..., i - 1]
    c[..., n - 1] = z / (z * z - 1) * (c[..., n - 1] + z * c[..., n - 2])
    for i in range(n - 2, -1, -1):
        c[..., i] = z * (c[..., i + 1] - c[..., i])
    return c


def _lines(volume: DataFrame, axis: str, value: str = "v") -> DataFrame:
    """The lines along ``axis``: the other two indices and ``line``, which must run from 0 without gaps or repeats."""
    others = [c for c in ("i", "j", "k") if c != axis]
    got = volume.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(F.col(axis).alias("a"), F.col(value).cast("double").alias("v")))).alias("_l"))
    whole = F.assert_true(F.forall(F.transform("_l", lambda e, i: (e["a"] == i) & e["v"].isNotNull()), lambda ok: ok), F.lit("the volume has gaps or repeats"))
    return got.select(*others, F.when(whole.isNull(), F.transform("_l", lambda e: e["v"])).alias("line"))


def spline_coefficients(volume: DataFrame) -> DataFrame:
    """``i, j, line``: B-spline coefficients of a whole volume ``(i, j, k, v)`` as lines along k.

    Each axis in turn is dealt out by lines, of which a task filters as many at once as a batch holds; no task sees
    more of the volume. Lines of one volume have the same length.
    """
    if volume.isEmpty():
        return volume.sparkSession.createDataFrame([], "i int, j int, line array<double>")
    sizes = volume.agg(*[F.max(c).alias(c) for c in ("i", "j", "k")]).first()
    current = volume.select("i", "j", "k", "v")
    for axis in ("i", "j", "k"):
        others = [c for c in ("i", "j", "k") if c != axis]
        n = sizes[axis] + 1

        def work(batches: Iterator[pd.DataFrame], others: list[str] = others, n: int = n) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    if {len(x) for x in batch["line"]} != {n}:
                        raise ValueError("the volume has gaps or repeats")
                    yield pd.DataFrame({**{c: batch[c] for c in others}, "line": list(_filtered(np.stack(batch["line"].to_numpy())))})

        kinds = ", ".join(f"{c} int" for c in others)
        lines = _lines(current.select(*[F.col(c).cast("int").alias(c) for c in ("i", "j", "k")], "v"), axis).mapInPandas(work, f"{kinds}, line array<double>")
        current = lines if axis == "k" else lines.select(*others, F.posexplode("line").alias(axis, "v"))
    return current


def cubic(points: DataFrame, volume: DataFrame) -> DataFrame:
    """``id, value``: the interpolating cubic spline at ``points(id, x, y, z)``; outside the volume null.

    A point asks sixteen lines of coefficients by key, mirrored at the edges, and takes four places of each.
    """
    s = volume.agg(*[F.max(c).alias(c) for c in ("i", "j", "k")]).first()
    if s["i"] is None:
        return points.select("id", F.lit(None).cast("double").alias("value"))
    n = [int(v) + 1 for v in s]
    mirror = lambda c, size: F.when(F.lit(size) == 1, 0).otherwise(F.least(F.abs(c), 2 * (size - 1) - F.abs(c))).cast("int")

    def weights(f):
        g = 1 - f
        return F.array(g * g * g / 6, (4 - 6 * f * f + 3 * f * f * f) / 6, (4 - 6 * g * g + 3 * g * g * g) / 6, f * f * f / 6)

    inside = F.lit(True)
    for c, size in zip("xyz", n):
        inside = inside & (F.col(c) >= 0) & (F.col(c) <= size - 1)
    base = points.where(inside).select("id", *[F.floor(c).cast("int").alias(f"_{c}") for c in "xyz"], *[weights(F.col(c) - F.floor(c)).alias(f"w{c}") for c in "xyz"])
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(4) for b in range(4)])
    each = base.withColumn("o", F.explode(corners)).select(
        "id", "_z", "wz", mirror(F.col("_x") + F.col("o.a") - 1, n[0]).alias("i"), mirror(F.col("_y") + F.col("o.b") - 1, n[1]).alias("j"),
        (F.get("wx", F.col("o.a")) * F.get("wy", F.col("o.b"))).alias("w"),
    )
    along = F.lit(0.0)
    for d in range(4):
        along = along + F.get("wz", F.lit(d)) * F.get("line", mirror(F.col("_z") + d - 1, n[2]))
    met = each.join(spline_coefficients(volume).hint("merge"), ["i", "j"]).groupBy("id").agg(F.sum(F.col("w") * along).alias("value"))
    return points.select("id").join(met, "id", "left")


def sample(points: DataFrame, volume: DataFrame, how: str = "cubic") -> DataFrame:
    """``id, value`` of each point by the ``nearest`` voxel, a ``linear`` or a ``cubic`` rule; outside null."""
    if how not in ("nearest", "linear", "cubic"):
        raise ValueError("how must be nearest, linear or cubic")
    return {"nearest": nearest, "linear": linear, "cubic": cubic}[how](points, volume)


#: The transforms between spaces: whether the target is a volume, and for surfaces what follows the sampling of depths.
TRANSFORMS = {
    "anat_to_func": "volume", "func_to_anat": "volume", "func_to_mni": "volume", "anat_to_mni": "volume",
    "func_to_surface": "surface", "func_to_fsaverage": "template",
}


def transform(kind: str, volume: DataFrame, coordinates: DataFrame, how: str = "cubic", correspondence: DataFrame | None = None, fill: float = 0.0) -> DataFrame:
    """A volume ``(i, j, k, v)`` in another space.

    ``coordinates`` say where each target place lies in the source, in voxels: ``(i, j, k, x, y, z)`` for a volume,
    ``(hemisphere, vertex, x, y, z)`` for a surface, ``(hemisphere, vertex, depth, x, y, z)`` for the template surface, whose
    depths are sampled each and averaged, then carried to template vertices by ``correspondence(hemisphere, vertex,
    source)``. Places outside the source are ``fill`` in a volume and null on a surface; depths outside are left out.
    """
    if kind not in TRANSFORMS:
        raise ValueError(f"kind must be one of {sorted(TRANSFORMS)}")
    target = TRANSFORMS[kind]
    if (correspondence is not None) != (target == "template"):
        raise ValueError("a correspondence of vertices belongs to the template surface alone")
    keys = {"volume": ["i", "j", "k"], "surface": ["hemisphere", "vertex"], "template": ["hemisphere", "vertex", "depth"]}[target]
    points = coordinates.select(F.struct(*keys).alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    got = sample(points, volume, how).select(*[F.col(f"id.{c}").alias(c) for c in keys], F.col("value").alias("v"))
    if target == "volume":
        return got.withColumn("v", F.coalesce("v", F.lit(float(fill))))
    if target == "surface":
        return got
    mean = got.groupBy("hemisphere", F.col("vertex").alias("source")).agg(F.avg("v").alias("v"))
    return correspondence.join(mean, ["hemisphere", "source"], "left").select("hemisphere", "vertex", "v")


def depth_mean(samples: DataFrame) -> DataFrame:
    """``vertex, t``: the mean over depths."""
    return samples.groupBy("vertex", "t").agg(F.avg("x").alias("x"))
