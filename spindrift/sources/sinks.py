"""Writers. Matrices and results are Parquet, tables are tab-separated; nothing is pickled."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_grid(values: DataFrame, grid: DataFrame, on: Sequence[str], fill: float | None = 0.0, value: str = "x") -> DataFrame:
    """Values back on the whole grid, ``fill`` outside the mask."""
    out = grid.join(values, list(on), "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def to_surface(values: DataFrame, model: DataFrame) -> DataFrame:
    """Values ``(voxel_id, t, x)`` with their structure and vertex, as 32-bit numbers; ids outside the model are an error."""
    out = values.join(model, "voxel_id", "left")
    ok = F.assert_true(F.col("structure").isNotNull(), F.lit("a value has no place in the brain model"))
    return out.withColumn("x", F.when(ok.isNull(), F.col("x")).cast("float"))


def write_matrix(df: DataFrame, path: str, by: Sequence[str] = ("run_id",)) -> None:
    """Partitioned Parquet, so that readers of some runs open no others."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def write_result(df: DataFrame, path: str, **about: str | float) -> None:
    """A result with its parameters as columns of a one-row table beside it."""
    df.write.mode("overwrite").parquet(f"{path}/values")
    spark = df.sparkSession
    spark.createDataFrame([tuple(about.values())], list(about)).write.mode("overwrite").json(f"{path}/about") if about else None


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_gifti(values: DataFrame, path: str, series: bool = False) -> None:
    """Surfaces ``(name, t, vertex, x)`` as GIFTI files ``path/name=<name>/*.txt``, one data array for each ``t``.

    ``series`` marks the arrays as frames rather than shapes. Vertices must run from 0 without gaps or
    repeats in each array, else it is an error; numbers are 32-bit, null is NaN (and read back as null). An array is one line of
    text, so a task holds one array at a time, and a long series is no larger a row than a short one.
    """

    @F.pandas_udf("string")
    def encoded(arrays: pd.Series) -> pd.Series:
        return pd.Series([base64.b64encode(np.asarray(a, "<f4").tobytes()).decode("ascii") for a in arrays], dtype="object")

    intent = "NIFTI_INTENT_TIME_SERIES" if series else "NIFTI_INTENT_SHAPE"
    x = F.coalesce(F.col("x").cast("float"), F.lit(float("nan")).cast("float"))
    v = F.col("vertex").cast("long")
    arrays = values.groupBy("name", F.col("t").cast("long").alias("t")).agg(F.sort_array(F.collect_list(F.struct(v.alias("v"), x.alias("x")))).alias("_v"))
    ok = F.assert_true(F.forall(F.transform("_v", lambda e, i: e["v"] == i), lambda same: same), F.lit("vertices have gaps or repeats"))
    arrays = arrays.withColumn("_x", F.when(ok.isNull(), F.transform("_v", lambda e: e["x"])))
    head = F.lit(f'<DataArray Intent="{intent}" DataType="NIFTI_TYPE_FLOAT32" ArrayIndexingOrder="RowMajorOrder" Dimensionality="1" Dim0="')
    tail = F.lit('" Encoding="Base64Binary" Endian="LittleEndian" ExternalFileName="" ExternalFileOffset=""><Data>')
    line = F.concat(head, F.size("_x").cast("string"), tail, encoded("_x"), F.lit("</Data></DataArray>"))
    body = arrays.select("name", F.lit(1).alias("_part"), "t", line.alias("value"))
    counts = values.groupBy("name").agg(F.count_distinct("t").alias("n"))
    opening = F.format_string('<?xml version="1.0" encoding="UTF-8"?><GIFTI Version="1.0" NumberOfDataArrays="%d">', F.col("n"))
    ends = [counts.select("name", F.lit(p).alias("_part"), F.lit(0).cast("long").alias("t"), text.alias("value")) for p, text in ((0, opening), (2, F.lit("</GIFTI>")))]
    lines = body.unionByName(ends[0]).unionByName(ends[1])
    # the partition column leads the order, so the writer has nothing left to sort
    lines.repartition("name").sortWithinPartitions("name", "_part", "t").select("name", "value").write.mode("overwrite").partitionBy("name").text(path)


def write_roi_pair(left: DataFrame, right: DataFrame, path: str) -> None:
    """A region's masks ``(vertex, in_mask)`` of both hemispheres as GIFTI, ``name=L`` and ``name=R``."""
    sides = [m.select(F.lit(n).alias("name"), F.lit(0).alias("t"), "vertex", F.col("in_mask").cast("int").alias("x")) for n, m in (("L", left), ("R", right))]
    write_gifti(sides[0].unionByName(sides[1]), path)


def label_table(keys: DataFrame) -> DataFrame:
    """``key, name, rgba`` with key 0 always present and colours by key."""
    from ..operators.labels import colour

    k = keys.select(F.col("key").cast("int").alias("key")).unionByName(keys.sparkSession.createDataFrame([(0,)], "key int")).distinct()
    name = F.when(F.col("key") == 0, "unlabelled").otherwise(F.concat(F.lit("label-"), F.col("key").cast("string")))
    return k.select("key", name.alias("name"), colour(F.col("key")).alias("rgba"))
