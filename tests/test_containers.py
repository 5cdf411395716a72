"""Image files: headers of both versions and byte orders, ranges, axes, labels, writing."""

import gzip
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from spindrift.sources import containers as C

MODELS = (
    C.Model(C.CORTEX[0], 0, 5, 9, np.array([0, 2, 3, 7, 8])),
    C.Model("CIFTI_STRUCTURE_THALAMUS_LEFT", 5, 3, None, np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]])),
    C.Model(C.CORTEX[1], 8, 4, 6, np.array([1, 2, 4, 5])),
)


def nifti1(x, order=">", kind="i2", slope=0.5, inter=10.0, gz=False, path=None):
    """A single-file NIfTI-1 volume written by hand, with an extension that isn't CIFTI's."""
    head = bytearray(352 + 32)
    dims = [4, *x.shape, 1, 1, 1]
    struct.pack_into(order + "i", head, 0, 348)
    struct.pack_into(order + "8h", head, 40, *dims)
    struct.pack_into(order + "2h", head, 70, {"i2": 4, "f4": 16, "u1": 2}[kind], np.dtype(kind).itemsize * 8)
    struct.pack_into(order + "8f", head, 76, 1, 2, 2, 2, 1.5, 1, 1, 1)
    struct.pack_into(order + "3f", head, 108, 384, slope, inter)
    struct.pack_into(order + "12f", head, 280, 2, 0, 0, -90, 0, 2, 0, -126, 0, 0, 2, -72)
    head[348] = 1
    struct.pack_into(order + "2i", head, 352, 32, 6)
    raw = bytes(head) + x.astype(order + kind).tobytes(order="F")
    with open(path, "wb") as f:
        f.write(gzip.compress(raw) if gz else raw)


def cells(reader):
    """What a reader gives, without Spark, and how many bytes of numbers it took."""
    got, read, start = [], [], C.Source.read
    C.Source.read = lambda self, offset, n: (read.append((offset, n)), start(self, offset, n))[1]
    try:
        for part in reader.partitions():
            read_header = len(read)
            for batch in reader.read(part):
                got += batch.to_pylist()
            read[read_header:] = [r for r in read[read_header:]]
    finally:
        C.Source.read = start
    return got, read


@pytest.mark.parametrize("gz", [False, True])
@pytest.mark.parametrize("order", "<>")
def test_nifti1(spark, tmp_path, order, gz):
    x = np.random.default_rng(1).integers(-300, 300, (3, 4, 2, 5))
    nifti1(x, order, gz=gz, path=str(p := tmp_path / f"a.nii{'.gz' * gz}"))
    got = C.read_container(spark, str(p), split=64).collect()
    assert len(got) == x.size
    assert all(r.value == x[r.i, r.j, r.k, r.frame] * 0.5 + 10 and r.place == r.i + 3 * r.j + 12 * r.k for r in got)
    series = C.read_container(spark, str(p), "series", split=64).collect()
    assert len(series) == 24 and all(r.ts == (x[r.i, r.j, r.k] * 0.5 + 10).tolist() for r in series)
    a = C.axes(spark, str(p)).first()
    assert (a.places, a.frames, a.frames_together, a.step, a.affine[1]) == (24, 5, False, 1.5, [0, 2, 0, -126])


@pytest.mark.parametrize("together", [False, True])
def test_one_frame_reads_its_bytes_only(tmp_path, together):
    big = (C.Model(C.CORTEX[0], 0, 200, 200, np.arange(200)),)
    frames = 30_000 if together else 50
    head = C.surface_header(big, frames, together=together)
    x = np.arange(200 * frames, dtype="<f4").reshape(200, frames)
    path = str(tmp_path / "a.dtseries.nii")
    with open(path, "wb") as f:
        f.write(head + (x if together else x.T).tobytes())
    reader = C.ContainerReader([path], False)
    assert list(reader.pushFilters([EqualTo(("frame",), 7), LessThan(("value",), 3)])) == [LessThan(("value",), 3)]
    got, read = cells(reader)
    assert [r["value"] for r in got] == x[:, 7].tolist() and {r["frame"] for r in got} == {7}
    data = [(a, n) for a, n in read if a >= len(head)]
    assert sum(n for _, n in data) == 200 * 4
    whole = C.ContainerReader([path], False)
    got, read = cells(whole)
    assert sum(n for a, n in read if a >= len(head)) == x.nbytes and len(got) == x.size


def test_conditions_choose_ranges(tmp_path):
    head = C.surface_header(MODELS, 10, together=False)
    x = np.arange(120, dtype="<f4").reshape(10, 12)
    path = str(tmp_path / "a.dtseries.nii")
    with open(path, "wb") as f:
        f.write(head + x.tobytes())
    reader = C.ContainerReader([path], False)
    some = In(("frame",), (3, 5))
    assert list(reader.pushFilters([some, EqualTo(("structure",), C.CORTEX[1]), GreaterThanOrEqual(("place",), 9)])) == [some]
    got, read = cells(reader)
    assert {(r["frame"], r["place"]): r["value"] for r in got} == {(t, p): x[t, p] for t in (3, 4, 5) for p in (9, 10, 11)}
    assert sum(n for a, n in read if a >= len(head)) == 9 * 4
    none = C.ContainerReader([path], False)
    list(none.pushFilters([LessThan(("frame",), 2), GreaterThanOrEqual(("frame",), 4)]))
    assert none.partitions() == []


@pytest.mark.parametrize("together", [False, True])
def test_surface_round_trip(spark, tmp_path, together):
    path = str(tmp_path / "b.dtseries.nii")
    x = np.random.default_rng(2).normal(size=(12, 6)).astype("f4")
    rows = [(t, p, float(x[p, t]) if (t, p) != (1, 1) else None) for t in range(6) for p in range(12) if (t, p) != (0, 0)]
    C.write_container(spark.createDataFrame(rows, "frame int, place long, value double").repartition(5), path, C.surface_header(MODELS, 6, 0.8, together))
    assert os.listdir(tmp_path) == ["b.dtseries.nii"]
    df = C.read_container(spark, path)
    got = {(r.frame, r.place): r for r in df.collect()}
    assert len(got) == 72 and got[0, 0].value == 0 and np.isnan(got[1, 1].value)
    assert all(got[t, p].value == x[p, t] for t in range(6) for p in range(12) if (t, p) not in ((0, 0), (1, 1)))
    assert [got[2, p].vertex for p in range(12)] == [0, 2, 3, 7, 8, None, None, None, 1, 2, 4, 5]
    assert [(got[2, p].i, got[2, p].j, got[2, p].k) for p in (5, 7, 8)] == [(1, 2, 3), (7, 8, 9), (None, None, None)]
    assert "frame" not in str(df.where("frame = 3")._jdf.queryExecution().optimizedPlan().getClass()) and df.where("frame = 3 and value is not null").count() == 12
    assert df.where(F.col("structure").isin(*C.CORTEX)).count() == 54
    s = C.structures(spark, path)
    assert [tuple(r)[1:] for r in s.orderBy("first").collect()] == [(b.structure, b.start, b.count, b.vertices, b.structure in C.CORTEX) for b in MODELS]
    full = C.scatter_surface(df.where("frame = 2"), s).collect()
    assert len(full) == 15 and {(r.structure, r.vertex): r.value for r in full if r.value is not None} == {(got[2, p].structure, got[2, p].vertex): got[2, p].value for p in (*range(5), *range(8, 12))}
    a = C.axes(spark, path).first()
    assert (a.places, a.frames, a.frames_together, a.step) == (12, 6, together, 0.8)


def test_labels(spark, tmp_path):
    given = [(0, 0, "none", (0.0, 0.0, 0.0, 0.0)), (0, 7, "gyrus <a> & b", (0.1, 0.2, 0.3, 1.0)), (0, 3, "early", (255.0, 51.0, 0.0, 255.0))]
    path = str(tmp_path / "c.dlabel.nii")
    C.write_container(spark.createDataFrame([(0, p, float((0, 3, 7)[p % 3])) for p in range(12)], "frame int, place int, value double"), path, C.surface_header(MODELS, 1, names=["parcels"], labels=given))
    assert [tuple(r)[1:] for r in C.label_tables(spark, path).collect()] == [(0, 0, "none", [0.0] * 4), (0, 3, "early", [1.0, 0.2, 0.0, 1.0]), (0, 7, "gyrus <a> & b", [0.1, 0.2, 0.3, 1.0])]
    assert C.read_container(spark, path).where("value = 7").count() == 4


def test_volume_round_trip_of_many_files(spark, tmp_path):
    affine = ((2, 0, 0, -10), (0, 3, 0, 5), (0, 0, 4, 1))
    for n in (1, 3):
        rows = [(t, p, float(100 * n + 10 * t + p)) for t in range(n) for p in range(8)]
        C.write_container(spark.createDataFrame(rows, "frame int, place int, value double"), f"{tmp_path}/v{n}.nii", C.volume_header((2, 2, 2), n, affine, 1.25))
    got = C.read_container(spark, f"{tmp_path}/*.nii").collect()
    assert len(got) == 32 and all(r.value == 100 * int(r.path[-5]) + 10 * r.frame + r.place for r in got)
    assert {(r.frames, r.step, tuple(map(tuple, r.affine))) for r in C.axes(spark, f"{tmp_path}/*.nii").collect()} == {(n, 1.25, affine) for n in (1, 3)}


@pytest.mark.parametrize("rows", [[(0, 0, 1.0), (0, 0, 2.0)], [(0, 8, 1.0)], [(1, 0, 1.0)], [(0, -1, 1.0)]])
def test_a_failed_write_leaves_nothing(spark, tmp_path, rows):
    with pytest.raises(Exception, match="twice or lies outside"):
        C.write_container(spark.createDataFrame(rows, "frame int, place int, value double"), f"{tmp_path}/w.nii", C.volume_header((2, 2, 2), 1))
    assert os.listdir(tmp_path) == []


def test_errors(spark, tmp_path):
    (tmp_path / "no.nii").write_bytes(b"x" * 1000)
    with pytest.raises(Exception, match="neither"):
        C.read_container(spark, str(tmp_path / "no.nii")).count()
    with pytest.raises(Exception):
        C.read_container(spark, str(tmp_path / "none*.nii")).count()
    with pytest.raises(ValueError, match="layout"):
        C.read_container(spark, str(tmp_path), "rows")
    with pytest.raises(ValueError, match="mounted"):
        C.write_container(spark.range(1), "s3://bucket/a.nii", b"")
    head = C.surface_header(MODELS, 10)
    twice = head[:544] + head[544:].replace(b"CIFTI_INDEX_TYPE_SERIES", b"CIFTI_INDEX_TYPE_BRAIN_MODELS"[:23].ljust(23))
    (tmp_path / "axes.nii").write_bytes(twice.replace(b"TYPE_BRAIN_MODELS", b"TYPE_PARCELS     "))
    with pytest.raises(ValueError, match="one brain axis"):
        C.header_of(str(tmp_path / "axes.nii"))
    nifti1(np.zeros((2, 2, 2, 3)), path=str(tmp_path / "short.nii"))
    os.truncate(tmp_path / "short.nii", 400)
    with pytest.raises(Exception, match="ends before"):
        C.read_container(spark, str(tmp_path / "short.nii")).count()
