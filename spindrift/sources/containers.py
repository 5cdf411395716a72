"""NIfTI-1/2 and CIFTI-2 files as a Spark data source that reads and writes byte ranges.

A file holds ``places`` (voxels, or the brain models' vertices and voxels) times ``frames`` (times, maps). A task
reads a range of places or frames and no more of the file than that; conditions on ``frame``, ``place`` and
``structure`` choose the ranges. Gzipped files can't be entered in the middle: each task unpacks up to its range,
a block at a time.
"""

from __future__ import annotations

import base64
import os
import posixpath
import struct
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

# Fixed values of the formats.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CIFTI_CODE = 32
CORTEX = ("CIFTI_STRUCTURE_CORTEX_LEFT", "CIFTI_STRUCTURE_CORTEX_RIGHT")
#: Bytes that a task reads, and values that a batch holds.
SPLIT, BATCH = 32 << 20, 1 << 18
PLACE = "path string, place long, i int, j int, k int, structure string, vertex long"
FRAMES, SERIES = f"{PLACE}, frame long, value double", f"{PLACE}, ts array<double>"


@dataclass(frozen=True)
class Model:
    """A brain model: ``count`` places from ``start`` on, each a vertex of a surface or a voxel of a grid."""

    structure: str
    start: int
    count: int
    vertices: int | None
    index: np.ndarray


@dataclass(frozen=True)
class Header:
    version: int
    order: str
    kind: str
    shape: tuple[int, ...]
    offset: int
    slope: float
    inter: float
    affine: tuple[tuple[float, ...], ...]
    step: float
    places: int
    frames: int
    inner: bool  #: frames of a place lie together, rather than places of a frame
    models: tuple[Model, ...] = ()
    names: tuple[str, ...] = ()
    labels: tuple[tuple[int, int, str, tuple[float, ...]], ...] = ()
    xml: bytes = b""

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize

    def at(self, frame: int, place: int) -> int:
        return self.offset + (place * self.frames + frame if self.inner else frame * self.places + place) * self.size


class Source:
    """A file read by ranges; a gzipped one from its start on, past what isn't wanted."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" not in path:
            path = "file://" + path.removeprefix("file:")
        self.system, self.path = fs.FileSystem.from_uri(path)
        with self.system.open_input_file(self.path) as f:
            self.packed = f.read(2) == b"\x1f\x8b"
        self.file, self.pos = None, 0

    def read(self, offset: int, n: int) -> bytes:
        if not self.packed:
            self.file = self.file or self.system.open_input_file(self.path)
            raw = self.file.read_at(n, offset)
        else:
            if self.file is None or offset < self.pos:
                self.file, self.pos = self.system.open_input_stream(self.path, compression="gzip"), 0
            while self.pos < offset:
                skipped = len(self.file.read(min(1 << 20, offset - self.pos)))
                if not skipped:
                    break
                self.pos += skipped
            raw = self.file.read(n)
            self.pos += len(raw)
        if len(raw) < n:
            raise ValueError(f"{self.path} ends before byte {offset + n}")
        return raw


def parse_cifti(xml: bytes) -> tuple[dict[int, str], list[Model], list[str], list[tuple], float, int]:
    """Of a CIFTI-2 extension: the kind of each dimension's map, brain models, map names, labels ``(map, key, name, rgba)``, step, points."""
    kinds, models, names, labels, step, points = {}, [], [], [], 0.0, 0
    for m in ElementTree.fromstring(xml.rstrip(b"\0").strip()).iter("MatrixIndicesMap"):
        kind = m.get("IndicesMapToDataType", "").removeprefix("CIFTI_INDEX_TYPE_")
        for d in m.get("AppliesToMatrixDimension", "").split(","):
            kinds[int(d)] = kind
        if kind == "SERIES":
            step, points = float(m.get("SeriesStep", 0)) * 10.0 ** int(m.get("SeriesExponent", 0)), int(m.get("NumberOfSeriesPoints", 0))
        for b in m.iter("BrainModel"):
            surface = b.get("ModelType") == "CIFTI_MODEL_TYPE_SURFACE"
            index = np.array(b.findtext("VertexIndices" if surface else "VoxelIndicesIJK", "").split(), np.int64)
            count = int(b.get("IndexCount"))
            if len(index) != count * (1 if surface else 3):
                raise ValueError(f"{b.get('BrainStructure')} has {count} places and {len(index)} indices")
            models.append(Model(b.get("BrainStructure"), int(b.get("IndexOffset")), count, int(b.get("SurfaceNumberOfVertices")) if surface else None, index if surface else index.reshape(-1, 3)))
        for k, named in enumerate(m.iter("NamedMap")):
            names.append((named.findtext("MapName") or "").strip())
            for x in named.iter("Label"):
                rgba = tuple(float(x.get(c, 0)) for c in ("Red", "Green", "Blue", "Alpha"))
                labels.append((k, int(x.get("Key")), (x.text or "").strip(), tuple(c / 255 for c in rgba) if 1 < max(rgba) <= 255 else rgba))
    return kinds, sorted(models, key=lambda b: b.start), names, labels, step, points


def parse_header(read) -> Header:
    """The header that ``read(offset, n)`` gives access to; neither format, or not exactly one brain axis, is an error."""
    first = read(0, 4)
    order = next((o for o in "<>" if struct.unpack(o + "i", first)[0] in (348, 540)), None)
    if order is None:
        raise ValueError("neither a NIfTI-1 nor a NIfTI-2 header")
    version = 1 if struct.unpack(order + "i", first)[0] == 348 else 2
    end = 348 if version == 1 else 540
    raw = read(0, end)
    get = lambda kind, at, n=1: struct.unpack_from(f"{order}{n}{kind}", raw, at)
    if version == 1:
        dim, code, pixdim, offset, (slope, inter) = get("h", 40, 8), get("h", 70)[0], get("f", 76, 8), int(get("f", 108)[0]), get("f", 112, 2)
        rows = [get("f", 280 + 16 * k, 4) for k in range(3)]
    else:
        dim, code, pixdim, offset, (slope, inter) = get("q", 16, 8), get("h", 12)[0], get("d", 104, 8), get("q", 168)[0], get("d", 176, 2)
        rows = [get("d", 400 + 32 * k, 4) for k in range(3)]
    if code not in KINDS:
        raise ValueError(f"numbers of kind {code} aren't read")
    shape = tuple(max(1, int(d)) for d in dim[1 : 1 + max(1, min(7, dim[0]))])
    if not slope or not np.isfinite(slope):
        slope, inter = 1.0, 0.0
    head = Header(version, order, order + KINDS[code], shape, offset, float(slope), float(inter), tuple(rows), float(pixdim[4]), int(np.prod(shape[:3])), int(np.prod(shape[3:])), False)
    at, xml = end + 4, b""
    if offset > at and read(end, 1) != b"\0":
        while at + 8 <= offset:
            n, kind = struct.unpack(order + "2i", read(at, 8))
            if n < 8:
                break
            if kind == CIFTI_CODE:
                xml = read(at + 8, n - 8)
                break
            at += n
    if not xml:
        return head
    kinds, models, names, labels, step, points = parse_cifti(xml)
    brain = [d for d in (0, 1) if kinds.get(d) == "BRAIN_MODELS"]
    if len(brain) != 1 or len(shape) != 6:
        raise ValueError(f"need one brain axis and one frame axis, have {kinds}")
    places, frames = shape[4 + brain[0]], shape[5 - brain[0]]
    if sum(b.count for b in models) != places or kinds[1 - brain[0]] == "SERIES" and points != frames:
        raise ValueError("the axes don't agree with the size of the matrix")
    return replace(head, step=step or head.step, places=places, frames=frames, inner=brain[0] == 1, models=tuple(models), names=tuple(names), labels=tuple(labels), xml=xml)


def header_of(path: str) -> Header:
    return parse_header(Source(path).read)


def blocks(source: Source, head: Header, frames: range, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """``start, values[place, frame]`` of the places from ``first`` to ``last``, so many at once as a batch holds."""
    each = max(1, BATCH // max(1, head.frames if head.inner else len(frames)))
    for a in range(first, last, each):
        n = min(each, last - a)
        if head.inner and head.frames * head.size <= 1 << 16 or head.inner and len(frames) == head.frames:
            x = np.frombuffer(source.read(head.at(0, a), n * head.frames * head.size), head.kind).reshape(n, head.frames)[:, frames.start : frames.stop : frames.step]
        elif head.inner:  # long rows: of each only from the first frame to the last
            raw = [source.read(head.at(frames[0], p), (frames[-1] - frames[0] + 1) * head.size) for p in range(a, a + n)]
            x = np.stack([np.frombuffer(r, head.kind)[:: frames.step] for r in raw])
        elif n == head.places and frames.step == 1:
            x = np.frombuffer(source.read(head.at(frames[0], 0), n * len(frames) * head.size), head.kind).reshape(len(frames), n).T
        else:
            x = np.stack([np.frombuffer(source.read(head.at(f, a), n * head.size), head.kind) for f in frames], axis=1)
        yield a, x.astype(float) * head.slope + head.inter


def place_columns(head: Header, path: str, places: np.ndarray) -> list[pa.Array]:
    """The columns of ``PLACE`` for these places."""
    n = len(places)
    if not head.models:
        x, y = (head.shape + (1, 1, 1))[:2]
        ijk = [places % x, places // x % y, places // (x * y)]
        return [pa.array([path] * n), pa.array(places), *[pa.array(c.astype(np.int32)) for c in ijk], pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
    ijk, vertex, structure = np.zeros((n, 3), np.int32), np.zeros(n, np.int64), np.full(n, None, object)
    voxel = np.zeros(n, bool)
    for b in head.models:
        inside = (places >= b.start) & (places < b.start + b.count)
        if inside.any():
            structure[inside] = b.structure
            if b.vertices is None:
                ijk[inside], voxel[inside] = b.index[places[inside] - b.start], True
            else:
                vertex[inside] = b.index[places[inside] - b.start]
    return [pa.array([path] * n), pa.array(places), *[pa.array(ijk[:, c], mask=~voxel) for c in range(3)], pa.array(structure, pa.string()), pa.array(vertex, mask=voxel)]


@dataclass
class Part(InputPartition):
    path: str
    frames: range
    first: int
    last: int


class ContainerReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], series: bool, split: int = SPLIT):
        self.paths, self.series, self.split, self.conditions = list(paths), series, split, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of frame and place with a number, and structures by name, choose what is read; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            number = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and name in ("frame", "place")
            if number or isinstance(f, (EqualTo, In)) and name == "structure":
                self.conditions.append(f)
                if isinstance(f, In):
                    yield f  # its range is read, Spark picks the members
            else:
                yield f

    def _range(self, name: str, n: int) -> range:
        low, high = 0, n
        for f in (f for f in self.conditions if f.attribute[0] == name):
            values = sorted(f.value) if isinstance(f, In) else [f.value]
            if isinstance(f, (EqualTo, In)):
                low, high = max(low, values[0]), min(high, values[-1] + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low = max(low, f.value + isinstance(f, GreaterThan))
            else:
                high = min(high, f.value + isinstance(f, LessThanOrEqual))
        return range(low, max(low, high))

    def _stretches(self, head: Header) -> list[tuple[int, int]]:
        wanted = [set(f.value if isinstance(f, In) else [f.value]) for f in self.conditions if f.attribute[0] == "structure"]
        some = self._range("place", head.places)
        if not wanted:
            return [(some.start, some.stop)]
        named = set.intersection(*wanted)
        each = [(max(b.start, some.start), min(b.start + b.count, some.stop)) for b in head.models if b.structure in named]
        return [(a, z) for a, z in each if a < z]

    def partitions(self) -> list[Part]:
        parts = []
        with ThreadPoolExecutor(16) as pool:
            for path, head in zip(self.paths, pool.map(header_of, self.paths)):
                frames = range(head.frames) if self.series else self._range("frame", head.frames)
                for a, z in self._stretches(head) if len(frames) else []:
                    fits = max(1, self.split // head.size)  # values of a task
                    per_place = head.frames if head.inner else len(frames)
                    if self.series or head.inner or z - a > fits:
                        runs = [frames] if self.series or head.inner else [frames[k : k + 1] for k in range(len(frames))]
                        each = max(1, fits // (per_place if self.series or head.inner else 1))
                        parts += [Part(path, run, s, min(s + each, z)) for run in runs for s in range(a, z, each)]
                    else:
                        each = max(1, fits // max(1, z - a))
                        parts += [Part(path, frames[k : k + each], a, z) for k in range(0, len(frames), each)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        source = Source(part.path)
        head = parse_header(source.read)
        names = [c.split()[0] for c in (SERIES if self.series else FRAMES).split(", ")]
        for start, x in blocks(source, head, part.frames, part.first, part.last):
            places = np.arange(start, start + len(x))
            if self.series:
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                columns = [*place_columns(head, part.path, places), pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x).ravel()))]
            else:
                once = place_columns(head, part.path, places)
                many = pa.array(np.tile(np.arange(len(x)), x.shape[1]))
                columns = [*[c.take(many) for c in once], pa.array(np.repeat(np.array(part.frames), len(x))), pa.array(x.T.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass
class Done(WriterCommitMessage):
    values: int


class ContainerWriter(DataSourceArrowWriter):
    """Cells ``(at, value)``, sorted by ``at`` in each task, to their offsets of one file, which appears when all are there."""

    def __init__(self, path: str, head: bytes, cells: int):
        self.path, self.cells, self.start = path, cells, len(head)
        self.temporary = posixpath.join(posixpath.dirname(path), f".{posixpath.basename(path)}.{uuid.uuid4().hex}")
        with open(self.temporary, "wb") as f:
            f.write(head)
            f.truncate(len(head) + 4 * cells)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Done:
        n, last = 0, -1
        file = os.open(self.temporary, os.O_WRONLY)
        try:
            for batch in batches:
                at, x = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype("<f4")
                if not len(at):
                    continue
                steps = np.diff(at, prepend=last)
                if at[0] < 0 or at[-1] >= self.cells or (steps <= 0).any():
                    raise ValueError("a cell is given twice or lies outside the grid")
                for run in np.split(np.arange(len(at)), np.flatnonzero(steps[1:] > 1) + 1):
                    raw, where = x[run].tobytes(), self.start + 4 * int(at[run[0]])
                    while raw:
                        done = os.pwrite(file, raw, where)
                        raw, where = raw[done:], where + done
                n, last = n + len(at), at[-1]
            os.fsync(file)
        finally:
            os.close(file)
        return Done(n)

    def commit(self, messages) -> None:
        os.replace(self.temporary, self.path)

    def abort(self, messages) -> None:
        if os.path.exists(self.temporary):
            os.remove(self.temporary)


class Container(DataSource):
    """Options: ``paths`` (one a line) and ``layout`` (series or frames) to read; ``path``, ``head`` (base64) and ``cells`` to write."""

    @classmethod
    def name(cls) -> str:
        return "spindrift_container"

    def schema(self) -> str:
        return SERIES if self.options.get("layout") == "series" else FRAMES

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self.options["paths"].split("\n"), self.options.get("layout") == "series", int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options["path"], base64.b64decode(self.options["head"]), int(self.options["cells"]))


def listed(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files under a path, a pattern or a list of them, as Spark lists them."""
    found = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path")
    return sorted(r.path for r in found.collect())


def read_container(spark: SparkSession, path: str | Sequence[str], layout: str = "frames", split: int = SPLIT) -> DataFrame:
    """NIfTI and CIFTI files as cells (``frames``: one row a place and frame) or as ``series`` (one row a place, frames in an array).

    ``i, j, k`` is the voxel, ``structure`` and ``vertex`` name a surface's place, ``place`` counts in file order.
    No file is an error, as is a file of neither format.
    """
    if layout not in ("frames", "series"):
        raise ValueError("layout must be frames or series")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Container)
    files = listed(spark, path)
    if not files:
        raise ValueError(f"no file at {path}")
    return spark.read.format("spindrift_container").option("paths", "\n".join(files)).option("layout", layout).option("split", split).load()


def _of_headers(spark: SparkSession, path: str | Sequence[str], schema: str, rows) -> DataFrame:
    """``rows(header)`` of every file, which tasks open."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches):
        import pandas as pd

        for batch in batches:
            for p in batch["path"]:
                yield pd.DataFrame([(p, *r) for r in rows(header_of(p))], columns=["path", *names])

    files = spark.createDataFrame([(p,) for p in listed(spark, path)], "path string")
    return files.repartition(max(1, min(256, files.count()))).mapInPandas(each, f"path string, {schema}")


def structures(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, structure, first, places, vertices, cortex``: where each brain model lies; a volume has none."""
    rows = lambda h: [(b.structure, b.start, b.count, b.vertices, b.structure in CORTEX) for b in h.models]
    return _of_headers(spark, path, "structure string, first long, places long, vertices long, cortex boolean", rows)


def label_tables(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, map, key, name, rgba`` of label files, colours from 0 to 1, by key."""
    found = _of_headers(spark, path, "map long, key long, name string, rgba array<double>", lambda h: [(m, k, n, list(c)) for m, k, n, c in h.labels])
    return found.orderBy("path", "map", "key")


def axes(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, places, frames, frames_together, step, affine``: which axis is time, and its step."""
    rows = lambda h: [(h.places, h.frames, h.inner, h.step, [list(r) for r in h.affine])]
    return _of_headers(spark, path, "places long, frames long, frames_together boolean, step double, affine array<array<double>>", rows)


def scatter_surface(cells: DataFrame, models: DataFrame) -> DataFrame:
    """``structure, vertex, frame, value`` for every vertex of each surface, null where the file has no place for it."""
    full = models.where("vertices is not null").select("path", "structure", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vertices") - 1)).alias("vertex"))
    frames = cells.select("path", "frame").distinct()
    return full.join(frames, "path").join(cells.select("path", "structure", "vertex", "frame", "value"), ["path", "structure", "vertex", "frame"], "left")


def volume_header(shape: Sequence[int], frames: int, affine: Sequence[Sequence[float]] = ((1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0)), step: float = 1.0) -> bytes:
    """A NIfTI-2 header of 32-bit numbers, up to where the numbers start."""
    raw = bytearray(544)
    struct.pack_into("<i8s2h8q", raw, 0, 540, b"n+2\0\r\n\x1a\n", 16, 32, 4 if frames > 1 else 3, *shape, frames, 1, 1, 1)
    struct.pack_into("<8d", raw, 104, 1.0, *[float(np.linalg.norm([r[c] for r in affine])) for c in range(3)], step, 1.0, 1.0, 1.0)
    struct.pack_into("<q2d", raw, 168, 544, 1.0, 0.0)
    struct.pack_into("<2i", raw, 344, 0, 1)
    for k, row in enumerate(affine):
        struct.pack_into("<4d", raw, 400 + 32 * k, *map(float, row))
    struct.pack_into("<i", raw, 500, 2 | 8)  # millimetres, seconds
    return bytes(raw)


def surface_header(models: Sequence[Model], frames: int, step: float = 1.0, together: bool = True, names: Sequence[str] = (), labels: Sequence[tuple] = ()) -> bytes:
    """A CIFTI-2 header: a series, or maps by name, with labels ``(map, key, name, rgba)`` if given; ``together`` keeps a place's frames side by side."""
    root = ElementTree.Element("CIFTI", Version="2")
    matrix = ElementTree.SubElement(root, "Matrix")
    frame_axis, brain_axis = ("0", "1") if together else ("1", "0")
    if names:
        m = ElementTree.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension=frame_axis, IndicesMapToDataType=f"CIFTI_INDEX_TYPE_{'LABELS' if labels else 'SCALARS'}")
        for k, name in enumerate(names):
            named = ElementTree.SubElement(m, "NamedMap")
            ElementTree.SubElement(named, "MapName").text = name
            if labels:
                listing = ElementTree.SubElement(named, "LabelTable")
                for _, key, label, rgba in (x for x in labels if x[0] == k):
                    ElementTree.SubElement(listing, "Label", Key=str(key), **{c: repr(float(v)) for c, v in zip(("Red", "Green", "Blue", "Alpha"), rgba)}).text = label
    else:
        ElementTree.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension=frame_axis, IndicesMapToDataType="CIFTI_INDEX_TYPE_SERIES", NumberOfSeriesPoints=str(frames), SeriesExponent="0", SeriesStart="0.0", SeriesStep=repr(float(step)), SeriesUnit="SECOND")
    m = ElementTree.SubElement(matrix, "MatrixIndicesMap", AppliesToMatrixDimension=brain_axis, IndicesMapToDataType="CIFTI_INDEX_TYPE_BRAIN_MODELS")
    for b in models:
        about = {"IndexOffset": str(b.start), "IndexCount": str(b.count), "BrainStructure": b.structure, "ModelType": f"CIFTI_MODEL_TYPE_{'VOXELS' if b.vertices is None else 'SURFACE'}"}
        one = ElementTree.SubElement(m, "BrainModel", about if b.vertices is None else about | {"SurfaceNumberOfVertices": str(b.vertices)})
        ElementTree.SubElement(one, "VoxelIndicesIJK" if b.vertices is None else "VertexIndices").text = " ".join(map(str, b.index.ravel().tolist()))
    return with_extension(ElementTree.tostring(root), sum(b.count for b in models), frames, together)


def with_extension(xml: bytes, places: int, frames: int, together: bool) -> bytes:
    room = -(-(len(xml) + 8) // 16) * 16
    raw = bytearray(volume_header((1, 1, 1), 1) + struct.pack("<2i", room, CIFTI_CODE) + xml.ljust(room - 8, b"\0"))
    struct.pack_into("<8q", raw, 16, 6, 1, 1, 1, 1, *((frames, places) if together else (places, frames)), 1)
    struct.pack_into("<q", raw, 168, len(raw))
    raw[540] = 1
    return bytes(raw)


def write_container(cells: DataFrame, path: str, head: bytes) -> None:
    """Cells ``(frame, place, value)`` as one file at ``path``, a folder that driver and tasks can write to by offset.

    Cells are dealt out by place in the file and each task writes its stretch; cells that aren't given are 0, null is
    NaN. A cell given twice or outside the grid is an error. The file takes its name when all tasks are done; after
    a failure nothing is left. A task that runs again writes the same bytes to the same place.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a file is written by offset: give a folder that is mounted")
    h = parse_header(lambda offset, n: head[offset : offset + n])
    frame, place = F.col("frame").cast("long"), F.col("place").cast("long")
    at = place * h.frames + frame if h.inner else frame * h.places + place
    inside = (frame >= 0) & (frame < h.frames) & (place >= 0) & (place < h.places)
    rows = cells.select(F.when(inside, at).otherwise(-1).alias("at"), F.coalesce(F.col("value").cast("float"), F.lit(float("nan")).cast("float")).alias("value"))
    rows.sparkSession.dataSource.register(Container)
    out = rows.repartitionByRange("at").sortWithinPartitions("at").write.format("spindrift_container").mode("append")
    out.option("path", path.removeprefix("file://").removeprefix("file:")).option("head", base64.b64encode(head).decode()).option("cells", h.places * h.frames).save()
