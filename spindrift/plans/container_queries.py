"""Queries over image files that are written from the matrix and read back by ranges."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import containers as C
from ..sources.shared import shared_dir
from . import inputs as I
from .inputs import MATRIX_SQL
from .registry import query

#: The 64 places of a vector as two surfaces, of which every second or third vertex is in the file.
LEFT, RIGHT, LEFT_VERTICES, RIGHT_VERTICES = 40, 24, 100, 90
MODELS = (
    C.Model(C.CORTEX[0], 0, LEFT, LEFT_VERTICES, 2 * np.arange(LEFT)),
    C.Model(C.CORTEX[1], LEFT, RIGHT, RIGHT_VERTICES, 3 * np.arange(RIGHT)),
)
_GRID_SQL = f"""SELECT g.t, g.voxel, CAST(coalesce(CAST(m.x AS FLOAT), 0) AS DOUBLE) AS x
  FROM (SELECT t, voxel FROM (SELECT unnest(range(0, last + 1)) AS t FROM (SELECT max(vec_id) AS last FROM embeddings)), range(0, 64) b(voxel)) g
  LEFT JOIN {MATRIX_SQL} m ON m.t = g.t AND m.voxel = g.voxel"""


def _written(spark: SparkSession, sf_dir: str, head: bytes, ending: str) -> str:
    path = f"{shared_dir(spark)}/container-{uuid.uuid4().hex}{ending}"
    C.write_container(I.matrix(spark, sf_dir).select(F.col("t").alias("frame"), F.col("voxel").alias("place"), F.col("x").alias("value")), path, head)
    return path


@query("volume_file", f"SELECT t, CAST(voxel % 8 AS INTEGER) AS i, CAST(voxel // 8 AS INTEGER) AS j, x FROM ({_GRID_SQL})")
def volume_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as a volume of 8 by 8, a frame a vector: written to one file and read back cell by cell."""
    path = _written(spark, sf_dir, C.volume_header((8, 8, 1), I.length(spark, sf_dir)), ".nii")
    return C.read_container(spark, path).select(F.col("frame").alias("t"), "i", "j", F.col("value").alias("x"))


@query(
    "surface_file",
    f"""WITH v AS (SELECT unnest(range(0, {LEFT_VERTICES})) AS vertex, 'L' AS side UNION ALL SELECT unnest(range(0, {RIGHT_VERTICES})), 'R'),
    p AS (SELECT side, vertex, CASE WHEN side = 'L' AND vertex % 2 = 0 AND vertex < {2 * LEFT} THEN vertex // 2 WHEN side = 'R' AND vertex % 3 = 0 AND vertex < {3 * RIGHT} THEN {LEFT} + vertex // 3 END AS voxel FROM v),
    g AS ({_GRID_SQL})
    SELECT side, vertex, f.t, g.x FROM p CROSS JOIN (SELECT DISTINCT t FROM g) f LEFT JOIN g ON g.t = f.t AND g.voxel = p.voxel""",
)
def surface_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix on two surfaces, frames of a place side by side, and back on all vertices."""
    path = _written(spark, sf_dir, C.surface_header(MODELS, I.length(spark, sf_dir)), ".dtseries.nii")
    full = C.scatter_surface(C.read_container(spark, path), C.structures(spark, path))
    side = F.when(F.col("structure") == C.CORTEX[0], "L").otherwise("R")
    return full.select(side.alias("side"), "vertex", F.col("frame").alias("t"), F.col("value").alias("x"))


@query("surface_series", f"SELECT 3 * (voxel - {LEFT}) AS vertex, count(*) AS n, round(avg(x), 6) AS mean, max(x) AS high FROM ({_GRID_SQL}) WHERE voxel >= {LEFT} GROUP BY voxel")
def surface_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one structure, whose places alone are read, each vertex's series."""
    path = _written(spark, sf_dir, C.surface_header(MODELS, I.length(spark, sf_dir), together=False), ".dtseries.nii")
    s = C.read_container(spark, path, "series").where(F.col("structure") == C.CORTEX[1])
    total = F.aggregate("ts", F.lit(0.0), lambda a, x: a + x)
    return s.select("vertex", F.size("ts").cast("long").alias("n"), F.round(total / F.size("ts"), 6).alias("mean"), F.array_max("ts").alias("high"))
