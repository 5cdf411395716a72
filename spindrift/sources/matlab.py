"""MATLAB version 5 files: variables, structures and cells as rows, and label arrays of two hemispheres.

A file is one tagged element after another, each perhaps compressed; a matrix element holds its flags, sizes, name and
numbers, and cells and structures hold further matrices. A task parses whole files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: kinds of numbers by element type; classes of matrices.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCTURE, OBJECT, CHARACTER, SPARSE = 1, 2, 3, 4, 5
COMPLEX = 0x0800
#: Numbers of a row, and vertices of a hemisphere of the usual surface.
STRETCH, VERTICES = 1 << 16, 32_492


def _elements(raw: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """Type and content of each element; content of up to four bytes may stand in the tag itself."""
    at = 0
    while at + 8 <= len(raw):
        kind, n = struct.unpack_from(order + "2I", raw, at)
        if kind >> 16:
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        if at + 8 + n > len(raw):
            raise ValueError("an element is longer than the file")
        yield kind, raw[at + 8 : at + 8 + n]
        at += 8 + (n if kind == COMPRESSED else -(-n // 8) * 8)


def _numbers(kind: int, raw: memoryview, order: str) -> np.ndarray:
    if kind not in NUMBERS:
        raise ValueError(f"numbers of kind {kind} aren't read")
    return np.frombuffer(raw, order + NUMBERS[kind])


def _text(kind: int, raw: memoryview, order: str) -> str:
    if kind in (1, 2, 16):
        return bytes(raw).decode("utf-8", "replace")
    return bytes(raw).decode({"<": "utf-16-le", ">": "utf-16-be"}[order] if kind in (4, 17) else {"<": "utf-32-le", ">": "utf-32-be"}[order], "replace")


def _matrix(raw: memoryview, order: str) -> tuple[str, object]:
    """Name and value of a matrix: numbers in their shape, text, a list of cells, or a list of structures (dicts)."""
    parts = list(_elements(raw, order))
    if not parts:
        return "", np.zeros((0, 0))
    flags = int(_numbers(*parts[0], order)[0])
    kind = flags & 0xFF
    if kind > 15 or len(parts) < 3:
        return "", None  # function handles and other opaque objects
    shape = tuple(int(n) for n in _numbers(*parts[1], order))
    name, rest = bytes(parts[2][1]).decode("latin-1"), parts[3:]
    if kind == CELL:
        return name, [_matrix(p, order)[1] for _, p in rest]
    if kind in (STRUCTURE, OBJECT):
        rest = rest[1:] if kind == OBJECT else rest
        width = int(_numbers(*rest[0], order)[0])
        listed = bytes(rest[1][1])
        fields = [listed[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(listed), max(1, width))]
        values = [_matrix(p, order)[1] for _, p in rest[2:]]
        return name, [dict(zip(fields, values[k : k + len(fields)])) for k in range(0, len(values), max(1, len(fields)))]
    if kind == CHARACTER:
        return name, _text(*rest[0], order) if rest else ""
    if kind == SPARSE:
        rows, starts, x = _numbers(*rest[0], order), _numbers(*rest[1], order), _numbers(*rest[2], order)
        out = np.zeros(shape)
        out[rows[: len(x)], np.repeat(np.arange(shape[1]), np.diff(starts))] = x
        return name, out
    x = _numbers(*rest[0], order)
    if flags & COMPLEX:
        x = x + 1j * _numbers(*rest[1], order)
    return name, x.reshape(shape, order="F")


def parse(raw: bytes) -> dict[str, object]:
    """The variables of a file by name. Another format (version 7.3 is HDF5) is an error."""
    order = {b"IM": "<", b"MI": ">"}.get(raw[126:128])
    if order is None or raw[:8] == b"\x89HDF\r\n\x1a\n":
        raise ValueError("not a MATLAB version 5 file")
    out = {}
    for kind, content in _elements(memoryview(raw)[128:], order):
        if kind == COMPRESSED:
            (kind, content), *_ = _elements(memoryview(zlib.decompress(content)), order)
        if kind == MATRIX:
            name, value = _matrix(content, order)
            if name:
                out[name] = value
    return out


def _leaves(at: str, value: object) -> Iterator[tuple[str, object]]:
    """Values below a variable, named ``a.field`` and ``a{place}`` (places from 1); one cell or structure alone needs no place."""
    if isinstance(value, list):
        for k, v in enumerate(value):
            here = at if len(value) == 1 and isinstance(v, dict) else f"{at}{{{k + 1}}}"
            if isinstance(v, dict):
                for field, x in v.items():
                    yield from _leaves(f"{here}.{field}", x)
            else:
                yield from _leaves(here, v)
    else:
        yield at, value


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, shape, start, values, imaginary, text``: the numbers of each array in column order, a stretch of them a row.

    Text has one row without numbers; empty arrays have one row with none; opaque objects have none at all.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                rows = []
                for variable, value in parse(bytes(content)).items():
                    for name, x in _leaves(variable, value):
                        if isinstance(x, str):
                            rows.append((p, name, None, 0, None, None, x))
                        elif x is not None:
                            flat = x.ravel(order="F")
                            for s in range(0, max(1, len(flat)), STRETCH):
                                part = flat[s : s + STRETCH]
                                rows.append((p, name, list(x.shape), s, part.real.astype(float).tolist(), part.imag.astype(float).tolist() if np.iscomplexobj(x) else None, None))
                yield pd.DataFrame(rows, columns=["path", "name", "shape", "start", "values", "imaginary", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, name string, shape array<long>, start long, values array<double>, imaginary array<double>, text string")


def hemisphere_labels(spark: SparkSession, path: str, left: str, right: str, container: str | None = None, vertices: int = VERTICES) -> DataFrame:
    """``path, hemisphere, vertex, label`` from the fields ``left`` and ``right`` of each file.

    They are looked for in the variable ``container`` if it is named, else among the variables themselves, else in the
    first variable that has both. Labels must be whole numbers and as many as ``vertices``; anything else is an error.
    """

    def pick(found: dict[str, object]) -> dict[str, object]:
        inside = lambda v: v[0] if isinstance(v, list) and len(v) == 1 and isinstance(v[0], dict) else {}
        if container is not None:
            if container not in found:
                raise ValueError(f"no variable {container}; there are {sorted(found)}")
            return inside(found[container])
        if left in found or right in found:
            return found
        for v in found.values():
            if left in inside(v) and right in inside(v):
                return inside(v)
        raise ValueError(f"no variable has {left} and {right}; there are {sorted(found)}")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"]):
                held = pick(parse(bytes(content)))
                for side, field in (("L", left), ("R", right)):
                    x = held.get(field)
                    if isinstance(x, list) and len(x) == 1:
                        x = x[0]
                    if not isinstance(x, np.ndarray) or np.iscomplexobj(x):
                        raise ValueError(f"{field} is missing or holds no numbers")
                    x = x.ravel(order="C").astype(float)
                    if len(x) != vertices:
                        raise ValueError(f"{field} has {len(x)} labels for {vertices} vertices")
                    if not (np.isfinite(x).all() and (x == np.round(x)).all()):
                        raise ValueError(f"labels of {field} must be whole numbers")
                    yield pd.DataFrame({"path": p, "hemisphere": side, "vertex": np.arange(vertices), "label": x.astype("int32")})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, "path string, hemisphere string, vertex long, label int")
