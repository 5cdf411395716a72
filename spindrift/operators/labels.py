"""Label operators: atlas keys, region masks, scatters to vertices, legends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find_keys(names: DataFrame, wanted: Sequence[str], match: str = "exact", ignore_case: bool = False) -> DataFrame:
    """Distinct ``key`` of the labels whose name equals or contains one of ``wanted``, in order.

    None found is an error that lists 30 of the names.
    """
    if match not in ("exact", "contains"):
        raise ValueError("match must be exact or contains")
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    name = low(F.col("name"))
    tests = [(name == low(F.lit(w))) if match == "exact" else F.contains(name, low(F.lit(w))) for w in wanted]
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    out = names.where(hit).select("key").distinct().orderBy("key")
    if out.isEmpty():
        some = [r[0] for r in names.select("name").distinct().orderBy("name").limit(30).collect()]
        raise ValueError(f"no label matches {list(wanted)}; there are {some}")
    return out


def roi_mask(vertices: DataFrame, keys: DataFrame) -> DataFrame:
    """``vertex, in_roi``: the label, rounded half to even, is one of ``keys``."""
    k = keys.select(F.col("key").cast("double").alias("_k")).distinct()
    return vertices.join(k, F.bround("label") == F.col("_k"), "left").select("vertex", F.col("_k").isNotNull().alias("in_roi"))


def scatter(full: DataFrame, values: DataFrame, on: str = "vertex") -> DataFrame:
    """Every vertex with its value, null where there is none."""
    return full.join(values, on, "left")


def discretise(df: DataFrame, label: str, out: str = "index") -> DataFrame:
    """Labels as 0, 1, ... in their order; the list of distinct labels is numbered, not the rows."""
    names = df.select(label).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(names, label)


def legend(values: DataFrame, names: DataFrame) -> DataFrame:
    """Values with the name of their key; unknown keys give null."""
    return values.join(names.select("key", "name"), values["label"] == names["key"], "left").drop("key")


def colour(key: Column) -> Column:
    """A label's colour by its key: red, green, blue, opaque; keys of 0 or less are transparent black."""
    # fixed values: the multipliers
    part = lambda m: F.pmod(key * m, F.lit(255)) / 255.0
    return F.when(key <= 0, F.array(*[F.lit(0.0)] * 4)).otherwise(F.array(part(37), part(91), part(173), F.lit(1.0)))


def hex_colour(text: Column) -> Column:
    """``#rrggbb`` or ``#rrggbbaa`` (the sign may be missing) as four numbers of 0 to 1; anything else is null."""
    h = F.lower(F.regexp_replace(text, "^#", ""))
    two = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("double") / 255
    alpha = F.when(F.length(h) == 8, two(7)).otherwise(1.0)
    return F.when(h.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$"), F.array(two(1), two(3), two(5), alpha))


def unit_colour(rgba: Column) -> Column:
    """Colours given as 0 to 255 brought to 0 to 1."""
    return F.when(F.array_max(rgba) > 1, F.transform(rgba, lambda c: c / 255)).otherwise(rgba)
