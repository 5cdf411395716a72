"""Principal components of matrices whose rows lie in many tasks: randomised block power iteration and a tall-skinny QR.

A pass multiplies each task's rows by a narrow block and sums what comes back, so nothing wider than a row times
the block leaves a task; the rows' own side is factored by a tree of QRs, of which only the small triangles move.
Neither the product of all columns with all columns nor any list of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to this long are factored in one pass, exactly; wider ones get a random block with so many columns to spare.
EXACT, SPARE = 256, 10
#: Rounds end early when the block's vectors are singular vectors up to this share of the largest value.
SETTLED = 1e-12
#: Triangles that reach the driver, and values that a task holds at once.
FAN, CHUNK = 16, 1 << 21


@dataclass
class Components:
    """``vectors`` (row length by k, orthonormal), singular ``values``, and what rows are centred by."""

    vectors: np.ndarray
    values: np.ndarray
    centre: str | None
    mean: np.ndarray | None
    rows: int


def _chunks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[np.ndarray]:
    """The vectors of a column as matrices of bounded size; a null or a vector of another length is an error."""
    for batch in batches:
        lists = batch.column(column)
        if lists.null_count or lists.flatten().null_count or len(lists) and set(np.diff(lists.offsets.to_numpy()).tolist()) != {width}:
            raise ValueError(f"every row must have {width} numbers")
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, width)
        each = max(1, CHUNK // max(1, width))
        for a in range(0, len(x), each):
            yield x[a : a + each]


def _centred(x: np.ndarray, centre: str | None, mean: np.ndarray | None) -> np.ndarray:
    return x - x.mean(1, keepdims=True) if centre == "rows" else x - mean if mean is not None else x


def _summed(rows: DataFrame, shape: tuple[int, int], width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part(matrix)`` over all rows: a partial matrix a task, summed by entry before it reaches the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for x in _chunks(batches, 0, width):
            total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), shape[1]).cast(pa.list_(pa.float64()))], names=["i", "v"])

    parts = rows.mapInArrow(work, "i long, v array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(shape[1])])
    out = np.zeros(shape)
    for r in sums.collect():  # a row of the narrow block for each place of a vector
        out[r[0]] = r[1:]
    return out


def _triangles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    r = np.zeros((0, size))
    for batch in batches:
        for raw in batch.column(1):
            r = np.linalg.qr(np.vstack([r, np.frombuffer(raw.as_buffer()).reshape(-1, size)]), "r")
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["p", "r"])


def tall_qr(rows: DataFrame, width: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """R of the QR of ``part(matrix)`` (``size`` columns) over all rows: each task's triangle, then triangles of triangles."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, size))
        for x in _chunks(batches, 0, width):
            r = np.linalg.qr(np.vstack([r, part(x)]), "r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()])], names=["p", "r"])

    level = rows.mapInArrow(own, "p long, r binary")
    for shuffled in (level.repartition, lambda p: level.repartition(FAN, p)):  # to as many tasks as a shuffle has, then to FAN
        level = shuffled("p").mapInArrow(lambda batches: _triangles(batches, size), "p long, r binary")
    stacked = [np.frombuffer(bytes(x.r)).reshape(-1, size) for x in level.collect()]  # FAN triangles
    return np.linalg.qr(np.vstack([np.zeros((0, size)), *stacked]), "r")


def decompose(rows: DataFrame, vector: str, k: int, n_iter: int = 10, centre: str | None = "columns", exact: int = EXACT, seed: int = 0) -> Components:
    """The ``k`` first right singular vectors of the rows' vectors, less the mean row (``columns``), each row's own mean (``rows``) or nothing.

    Each vector's largest entry is positive, so results repeat. Vectors longer than ``exact`` go through ``n_iter``
    rounds of block power iteration from a seeded random block, fewer if it settles; the error falls with the ratio of the singular values
    after and at ``k`` to the power 2 n_iter + 1. ``rows`` is read once a round: write it first if it is dear.
    No rows give no component; fewer rows than ``k`` as many as there are.
    """
    if centre not in ("columns", "rows", None):
        raise ValueError("centre must be columns, rows or None")
    rows = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    first = rows.where("v is not null").first()
    if first is None:
        return Components(np.zeros((0, 0)), np.zeros(0), centre, None, 0)
    m = len(first[0])
    totals = _summed(rows, (m, 2), m, lambda x: np.stack([x.sum(0), np.full(m, len(x))], 1))
    n, mean = int(totals[0, 1]), totals[:, 0] / max(totals[0, 1], 1) if centre == "columns" else None
    if m <= exact:
        z = np.eye(m)
    else:
        z = np.linalg.qr(np.random.default_rng(seed).normal(size=(m, min(m, k + SPARE))))[0]

        def power(x: np.ndarray, z: np.ndarray) -> np.ndarray:
            x = _centred(x, centre, mean)
            return x.T @ (x @ z)

        for _ in range(n_iter + 1):
            s = _summed(rows, z.shape, m, lambda x, z=z: power(x, z))
            ritz, w = np.linalg.eigh((z.T @ s + s.T @ z) / 2)
            rest = s @ w[:, -k:] - z @ w[:, -k:] * ritz[-k:]
            z = np.linalg.qr(s)[0]
            if np.linalg.norm(rest, axis=0).max() <= SETTLED * ritz[-1]:
                break
    r = tall_qr(rows, m, z.shape[1], lambda x: _centred(x, centre, mean) @ z)
    _, values, vt = np.linalg.svd(r, full_matrices=False)
    k = min(k, len(values), n)
    vectors = z @ vt[:k].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return Components(vectors, values[:k], centre, mean, n)


def projected(rows: DataFrame, key: str, vector: str, weights: np.ndarray, centre: str | None = None, value: str = "score") -> DataFrame:
    """``key, component, value``: each row's vector times ``weights``, less its own mean first with ``rows``. Map-only."""
    width = len(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _chunks(iter([batch]), 1, width):
                y = _centred(x, centre, None) @ weights
                keys = batch.column(0).slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), y.shape[1])))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.tile(np.arange(y.shape[1], dtype=np.int32), len(x))), pa.array(y.ravel())], names=[key, "component", value])
                at += len(x)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(f"`{vector}`").cast("array<double>")).mapInArrow(work, f"`{key}` {kind}, component int, {value} double")


def time_scores(rows: DataFrame, vector: str, found: Components) -> np.ndarray:
    """For rows that are voxels: the uncentred matrix, times by voxels, times the voxels' singular vectors. One pass."""
    rows = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    u, s, centre = found.vectors, np.where(found.values > 0, found.values, np.inf), found.centre
    return _summed(rows, u.shape, len(u), lambda x: x.T @ (_centred(x, centre, None) @ u / s))
