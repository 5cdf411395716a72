"""Readers of event timing, physiological and label files."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import trim_trigger, zscore_wide
from .containers import read_container


def read_physio(spark: SparkSession, path: str, columns: Sequence[str], normalise: bool = False) -> DataFrame:
    """A processed table (tab-separated with a header, gzip or not); ``normalise`` z-scores each file's columns."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.read.csv(path, sep="\t", header=True, schema=schema).withColumn("file", F.input_file_name())
    return (zscore_wide(df, list(columns), ["file"]) if normalise else df).drop("file")


def indexed(spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """Headerless numeric files with ``ix``, the row's place in its file. One file is one partition (gzip can't be split)."""
    schema = ", ".join(f"`{c}` double" for c in columns)
    df = spark.read.option("maxPartitionBytes", 1 << 40).csv(path, sep=sep, schema=schema)
    order = df.withColumns({"_f": F.input_file_name(), "_o": F.monotonically_increasing_id()})
    return order.withColumn("ix", F.row_number().over(Window.partitionBy("_f").orderBy("_o")) - 1).drop("_f", "_o")


def sidecar(spark: SparkSession, path: str) -> tuple[list[str], float]:
    """Column names and sampling rate from a JSON sidecar; a missing one is an error."""
    got = spark.read.schema("Columns array<string>, SamplingFrequency double").option("multiLine", "true").json(path).first()
    if got is None or got["Columns"] is None or got["SamplingFrequency"] is None:
        raise ValueError(f"{path} needs Columns and SamplingFrequency")
    return list(got["Columns"]), got["SamplingFrequency"]


def read_triggered(spark: SparkSession, path: str, sidecar_path: str, columns: Sequence[str] | None = None, trigger: str = "trigger") -> tuple[DataFrame, float]:
    """A recording whose names and rate are in its sidecar, cut to between its first and last trigger."""
    names, rate = sidecar(spark, sidecar_path)
    missing = sorted(set(columns or ()) - set(names))
    if missing:
        raise ValueError(f"columns {missing} are not in {names}")
    df = indexed(spark, path, names).withColumn("run", F.lit(0))
    df = trim_trigger(df, trigger, ["run"], "ix").drop("run")
    return df.select("ix", *(columns or [n for n in names if n != trigger])), rate


def read_pair(spark: SparkSession, pulse: str, respiration: str) -> tuple[DataFrame, float]:
    """Two one-column recordings side by side at 50 Hz; the shorter one ends in nulls."""
    a, b = indexed(spark, pulse, ["cardiac"]), indexed(spark, respiration, ["respiratory_effort"])
    return a.join(b, "ix", "full"), 50.0


def write_physio(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("compression", "gzip").csv(path, header=True)


def timing(spark: SparkSession, onsets: str, durations: str, condition: str) -> DataFrame:
    """``trial_type, onset, duration`` from two one-line files of numbers; unequal counts are an error."""
    def numbers(path: str, name: str) -> DataFrame:
        line = spark.read.text(path, wholetext=True).select(F.split(F.trim(F.regexp_replace("value", r"\s+$", "")), " +").alias("v"))
        return line.select(F.posexplode("v").alias("k", name)).withColumn(name, F.col(name).cast("double"))

    both = numbers(onsets, "onset").join(numbers(durations, "duration"), "k", "full")
    ok = F.assert_true(F.col("onset").isNotNull() & F.col("duration").isNotNull(), F.lit("onsets and durations differ in number"))
    return both.select(F.lit(condition).alias("trial_type"), F.when(ok.isNull(), F.col("onset")).alias("onset"), "duration")


def paired_timing(lines: DataFrame, condition: str) -> DataFrame:
    """From lines of ``onset:duration`` tokens (column ``value``); a negative onset means no event."""
    token = F.split("tok", ":")
    out = lines.select(F.explode(F.split(F.trim("value"), " +")).alias("tok")).select(
        F.lit(condition).alias("trial_type"), F.get(token, F.lit(0)).cast("double").alias("onset"), F.get(token, F.lit(1)).cast("double").alias("duration")
    )
    return out.where(F.col("onset") >= 0)


def event_frame(parts: Sequence[DataFrame], session: str) -> DataFrame:
    """All conditions of a session by onset, then type."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(session).alias("session"), "onset", "duration", "trial_type").orderBy("onset", "trial_type")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated event table with a header; an empty one is an error."""
    df = spark.read.csv(path, sep="\t", header=True, schema="onset double, duration double, trial_type string")
    if df.isEmpty():
        raise ValueError(f"{path} has no event")
    return df


def label_map_json(text: str, spark: SparkSession) -> DataFrame:
    """``key, name, colour, rgba`` of a JSON label map: an object by key, or a list of objects with ``id``.

    A value is a name, or an object with ``name`` and ``color`` (hexadecimal text, or three or four numbers).
    Entries without a whole number as key go.
    """
    import json

    from ..operators.labels import unit_colour

    given = json.loads(text)
    pairs = given.items() if isinstance(given, dict) else [(x.get("id"), x) for x in given if isinstance(x, dict)]
    rows = []
    for key, v in pairs:
        v = {"name": v} if isinstance(v, str) else v if isinstance(v, dict) else {}
        name, colour = v.get("name"), v.get("color")
        numbers = [float(c) for c in colour] if isinstance(colour, list) and len(colour) in (3, 4) else None
        rows.append((str(key), name if isinstance(name, str) else None, colour if isinstance(colour, str) else None, numbers + [1.0] * (4 - len(numbers)) if numbers else None))
    out = spark.createDataFrame(rows, "key string, name string, colour string, rgba array<double>")
    return out.select(F.expr("try_cast(key as int)").alias("key"), "name", "colour", unit_colour(F.col("rgba")).alias("rgba")).where("key is not null")


def label_map(text: DataFrame) -> DataFrame:
    """``key, name, colour`` from lines (column ``value``) of ``key<TAB or comma>name[<TAB or comma>colour]``; unreadable lines go."""
    p = F.split("value", "[\t,]")
    out = text.select(F.try_to_number(F.trim(F.get(p, F.lit(0))), F.lit("999999999")).cast("int").alias("key"), F.trim(F.get(p, F.lit(1))).alias("name"), F.trim(F.get(p, F.lit(2))).alias("colour"))
    return out.where("key is not null and name is not null and name <> ''")


def decode_gifti(xml: bytes) -> tuple[list[list[float]], dict[int, str]]:
    """Data arrays (base64, gzip or not, 32-bit) and the label table of a GIFTI file."""
    from xml.etree import ElementTree


    root = ElementTree.fromstring(xml)
    names = {int(x.get("Key", x.get("Index", "0"))): (x.text or "").strip() for x in root.iter("Label")}
    arrays = []
    for a in root.iter("DataArray"):
        kind = {"NIFTI_TYPE_INT32": "i4", "NIFTI_TYPE_FLOAT32": "f4", "NIFTI_TYPE_UINT8": "u1"}[a.get("DataType")]
        raw = base64.b64decode("".join(a.findtext("Data", "").split()))
        if a.get("Encoding") == "GZipBase64Binary":
            raw = zlib.decompress(raw)
        order = "<" if a.get("Endian", "LittleEndian") == "LittleEndian" else ">"
        arrays.append(np.frombuffer(raw, order + kind).astype(float).tolist())
    return arrays, names


def read_gifti(spark: SparkSession, path: str) -> DataFrame:
    """``path, array, vertex, value`` of every data array of GIFTI files. A file without arrays is an error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                arrays, _ = decode_gifti(bytes(content))
                if not arrays:
                    raise ValueError(f"{p} has no data array")
                for k, values in enumerate(arrays):
                    yield pd.DataFrame({"path": p, "array": k, "vertex": range(len(values)), "value": values})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, array int, vertex int, value double")


def read_gifti_labels(spark: SparkSession, path: str) -> DataFrame:
    """``path, key, name`` of the label tables; none is an error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                names = decode_gifti(bytes(content))[1]
                if not names:
                    raise ValueError(f"{p} has no label table")
                yield pd.DataFrame({"path": p, "key": list(names), "name": list(names.values())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, key int, name string")


def vertex_mask(values: DataFrame) -> DataFrame:
    """``vertex, in_mask``: finite and not zero."""
    x = F.col("value")
    return values.select("vertex", (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (x != 0)).alias("in_mask"))


def read_nifti(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, i, j, k, ts`` of NIfTI files (a path, or a list of them): one row per voxel, its series as an array; read by byte ranges."""
    return read_container(spark, path, "series").select("path", "i", "j", "k", "ts")


def masked(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels of the mask ``(i, j, k)`` only, numbered by x, y, z within their file."""
    m = mask.select("i", "j", "k").distinct()
    ids = m.withColumn("voxel_id", F.row_number().over(Window.orderBy("i", "j", "k")) - 1)
    return voxels.join(ids, ["i", "j", "k"])


def echo_cube(echoes: DataFrame, by: Sequence[str] = ("voxel_id",)) -> DataFrame:
    """``voxel_id, series`` (or other keys): the series of each voxel's echoes, in order of ``echo``."""
    return echoes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("echo", "ts"))).alias("_e")).select(*by, F.transform("_e", lambda e: e["ts"]).alias("series"))
