"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_log(x: Column, least: float) -> Column:
    """ln(max(x, least)); a missing value stays missing."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.ln(F.greatest(x, F.lit(least))))


def clip(x: Column, low: float, high: float) -> Column:
    """Between the bounds; null and NaN stay as they are."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def capped_ratio(k: float, b: Column, cap: float) -> Column:
    """k / b, at most ``cap``, for positive b; else null."""
    return F.when(b > 0, F.least(F.lit(cap), F.lit(k) / F.nullif(b, F.lit(0.0))))


def fisher_z(r: Column, eps: float = 1e-7) -> Column:
    return F.when(r.isNotNull() & ~F.isnan(r), F.atanh(F.greatest(F.lit(-1 + eps), F.least(F.lit(1 - eps), r))))


def truncated_index(seconds: Column, tr: float) -> Column:
    return (seconds / tr).cast("int")


def nearest_index(x: Column, step: float, n: int) -> Column:
    """The first grid point at or after x, the last one if there's none."""
    return F.least(F.greatest(F.ceil(x / step), F.lit(0)), F.lit(n - 1)).cast("int")


def fwhm_to_sigma(fwhm: Column) -> Column:
    return fwhm / 2.3548


def affine(matrix: list[list[float]], ijk: list[Column]) -> list[Column]:
    """World coordinates of voxel indices by a 4 x 4 (or 3 x 4) matrix."""
    return [ijk[0] * row[0] + ijk[1] * row[1] + ijk[2] * row[2] + row[3] for row in matrix[:3]]


def frame_time(t0: int, index: Column, tr: float) -> Column:
    return (index + t0) * tr


def json_field(text: Column, name: str, required: bool = False) -> Column:
    """A field of a JSON object as text; a required one that is missing is an error."""
    got = F.get_json_object(text, f"$.{name}")
    return F.coalesce(got, F.raise_error(F.lit(f"no field {name}")).cast("string")) if required else got


def floats(text: Column) -> Column:
    """A comma-separated list of numbers; negative ones are an error."""
    got = F.transform(F.split(text, ","), lambda s: F.trim(s).cast("double"))
    return F.when(F.assert_true(~F.exists(got, lambda v: v < 0), F.lit("negative number")).isNull(), got)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def with_desc(path: Column, desc: str) -> Column:
    """The file name with its ``desc-`` entity set: replaced where there is one, else put before the suffix."""
    swapped = F.regexp_replace(path, "_desc-[^_./]+", f"_desc-{desc}")
    added = F.regexp_replace(path, r"_([A-Za-z0-9]+)(\.[^/]*)$", f"_desc-{desc}_$1$2")
    return F.when(path.rlike("_desc-[^_./]+"), swapped).otherwise(added)


def decay_name(path: Column, kind: str, space: str | None = None) -> Column:
    """The name of a decay map (``t2`` or ``s0``) beside the run's first echo: the echo gone, or the space in its place."""
    placed = F.regexp_replace(path, "_echo-1", f"_space-{space}" if space else "")
    return F.regexp_replace(placed, "desc-preproc", f"desc-preproc{kind}")


def stem(path: Column) -> Column:
    """Without the extension, compressed or compound ones included."""
    return F.regexp_replace(path, r"(\.dtseries|\.func|\.label)?\.(nii|gii|tsv|json|csv)(\.gz)?$", "")


def prefix_path(path: Column, suffix: str) -> Column:
    """An output prefix: the hemisphere and extension parts of a file name removed, ``suffix`` appended."""
    return F.concat(F.regexp_replace(path, r"(\.[LR])?(\.(label|func|shape))?\.gii$", ""), F.lit(suffix))
