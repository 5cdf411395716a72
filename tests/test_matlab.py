"""MATLAB files made by hand: both byte orders, compressed elements, nested cells and structures."""

import struct
import zlib

import numpy as np
import pytest

from spindrift.sources import matlab as M


def element(order, kind, raw):
    if 0 < len(raw) <= 4:  # small elements stand in the tag
        return struct.pack(order + "I", len(raw) << 16 | kind) + raw.ljust(4, b"\0")
    return struct.pack(order + "2I", kind, len(raw)) + raw.ljust(-(-len(raw) // 8) * 8, b"\0")


def matrix(order, name, value, kind=None):
    def inner(cls, shape, flags=0):
        return element(order, 6, struct.pack(order + "2I", cls | flags, 0)) + element(order, 5, np.array(shape, order + "i4").tobytes()) + element(order, 1, name.encode())

    if isinstance(value, str):
        body = inner(4, (1, len(value))) + element(order, 4, value.encode("utf-16-le" if order == "<" else "utf-16-be"))
    elif isinstance(value, list):
        body = inner(1, (1, len(value))) + b"".join(matrix(order, "", v) for v in value)
    elif isinstance(value, dict):
        names = b"".join(k.encode().ljust(32, b"\0") for k in value)
        body = inner(2, (1, 1)) + element(order, 5, struct.pack(order + "i", 32)) + element(order, 1, names) + b"".join(matrix(order, "", v) for v in value.values())
    else:
        x = np.asarray(value)
        stored = {"float64": (6, 9, "f8"), "int32": (12, 5, "i4"), "uint8": (9, 2, "u1"), "complex128": (6, 9, "f8")}[x.dtype.name]
        body = inner(stored[0], x.shape if x.ndim > 1 else (1, len(x)), 0x0800 if np.iscomplexobj(x) else 0)
        body += element(order, stored[1], x.real.astype(order + stored[2]).tobytes(order="F"))
        if np.iscomplexobj(x):
            body += element(order, 9, x.imag.astype(order + "f8").tobytes(order="F"))
    return struct.pack(order + "2I", 14, len(body)) + body


def write(path, order, packed, **variables):
    raw = b"made by hand".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI")
    for name, value in variables.items():
        one = matrix(order, name, value)
        if packed:
            z = zlib.compress(one)
            one = struct.pack(order + "2I", 15, len(z)) + z
        raw += one
    path.write_bytes(raw)
    return str(path)


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("order", "<>")
def test_values_and_names(spark, tmp_path, order, packed):
    x = np.arange(6.0).reshape(2, 3)
    p = write(tmp_path / "a.mat", order, packed, x=x, n=np.array([[7]], "int32"), word="Äpfel", z=np.array([1 + 2j, 3]), c=[np.array([1.0]), "in", [np.zeros((0, 0))]], s={"lh": np.array([1, 2, 255], "uint8"), "deep": {"t": "x"}})
    got = {r.name: r for r in M.read_mat(spark, p).collect()}
    assert got["x"].shape == [2, 3] and got["x"]["values"] == [0, 3, 1, 4, 2, 5]
    assert got["n"]["values"] == [7] and got["word"].text == "Äpfel" and got["z"].imaginary == [2, 0]
    assert got["c{1}"]["values"] == [1] and got["c{2}"].text == "in" and got["c{3}{1}"]["values"] == []
    assert got["s.lh"]["values"] == [1, 2, 255] and got["s.deep.t"].text == "x"
    assert len(got) == 9


def test_long_arrays_come_in_stretches(spark, tmp_path):
    x = np.arange(150_000.0)
    rows = M.read_mat(spark, write(tmp_path / "b.mat", "<", True, x=x)).orderBy("start").collect()
    assert [r.start for r in rows] == [0, 65536, 131072] and sum((r["values"] for r in rows), []) == x.tolist()


def test_hemispheres(spark, tmp_path):
    left, right = np.arange(10.0), np.arange(10, 20, dtype="int32")
    where = {"top": {"lh": left, "rh": right}, "inside": {"other": {"lh": left}, "atlas": {"lh": left, "rh": right}}}
    for name, variables in where.items():
        got = M.hemisphere_labels(spark, write(tmp_path / f"{name}.mat", "<", True, **variables), "lh", "rh", vertices=10).collect()
        assert {(r.hemisphere, r.vertex): r.label for r in got} == {**{("L", k): k for k in range(10)}, **{("R", k): 10 + k for k in range(10)}}
    p = str(tmp_path / "inside.mat")
    assert M.hemisphere_labels(spark, p, "lh", "rh", "atlas", 10).count() == 20
    for options, said in (({"container": "no"}, "no variable"), ({"container": "other"}, "missing"), ({"vertices": 11}, "10 labels"), ({"left": "xx"}, "no variable has")):
        with pytest.raises(Exception, match=said):
            M.hemisphere_labels(spark, p, **{"left": "lh", "right": "rh", "vertices": 10} | options).collect()
    half = write(tmp_path / "half.mat", "<", False, lh=left + 0.5, rh=right)
    with pytest.raises(Exception, match="whole"):
        M.hemisphere_labels(spark, half, "lh", "rh", vertices=10).collect()


def test_other_formats(spark, tmp_path):
    (tmp_path / "h.mat").write_bytes(b"\x89HDF\r\n\x1a\n".ljust(600))
    with pytest.raises(Exception, match="version 5"):
        M.read_mat(spark, str(tmp_path / "h.mat")).collect()
    good = (tmp_path / "t.mat", "<", False)
    p = write(*good, x=np.arange(9.0))
    raw = (tmp_path / "t.mat").read_bytes()
    (tmp_path / "t.mat").write_bytes(raw[:-16])
    with pytest.raises(Exception, match="longer"):
        M.read_mat(spark, p).collect()
