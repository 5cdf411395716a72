"""Cubic sampling and the transforms between spaces."""

import numpy as np
import pytest

from spindrift.operators import spatial as G

SHAPE = (5, 4, 6)


def volume(spark, x):
    return spark.createDataFrame([(i, j, k, float(v)) for (i, j, k), v in np.ndenumerate(x)], "i int, j int, k int, v double").repartition(5)


def basis(n):
    """Values at whole places of mirrored cubic B-splines, a column each."""
    b = np.zeros((n, n))
    for i in range(n):
        for d, w in ((-1, 1 / 6), (0, 4 / 6), (1, 1 / 6)):
            m = abs(i + d)
            b[i, min(m, 2 * (n - 1) - m) if n > 1 else 0] += w
    return b


def plain(x, p):
    c = x
    for axis in range(3):
        c = np.moveaxis(np.linalg.solve(basis(x.shape[axis]), np.moveaxis(c, axis, 0).reshape(x.shape[axis], -1)).reshape(np.moveaxis(c, axis, 0).shape), 0, axis)
    if any(not 0 <= v <= n - 1 for v, n in zip(p, x.shape)):
        return None
    w = []
    for v, n in zip(p, x.shape):
        row, f = np.zeros(n), int(np.floor(v))
        for d in range(-1, 3):
            t = abs(v - (f + d))
            m = abs(f + d)
            row[min(m, 2 * (n - 1) - m)] += (2 / 3 - t * t + t**3 / 2) if t < 1 else max(0.0, 2 - t) ** 3 / 6
        w.append(row)
    return float(np.einsum("i,j,k,ijk", *w, c))


def test_cubic_equals_a_dense_solve(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=SHAPE)
    points = [(n, *map(float, r.uniform(-0.5, np.array(SHAPE) - 0.5))) for n in range(60)] + [(100, 0.0, 0.0, 0.0), (101, 4.0, 3.0, 5.0), (102, 2.0, 1.0, 3.0)]
    got = {q.id: q.value for q in G.sample(spark.createDataFrame(points, "id int, x double, y double, z double"), volume(spark, x)).collect()}
    assert len(got) == 63
    for n, *p in points:
        wanted = plain(x, p)
        assert (got[n] is None) == (wanted is None) and (wanted is None or got[n] == pytest.approx(wanted, abs=1e-9)), p
    assert got[102] == pytest.approx(x[2, 1, 3])


def test_cubic_reproduces_a_straight_line_and_curves_inside(spark):
    x = np.fromfunction(lambda i, j, k: np.sin(i / 8) + np.cos(j / 9) * np.sin(k / 10), (24, 24, 24))
    points = [(n, 8 + n * 0.7, 9.3 + n * 0.3, 12.2 - n * 0.4) for n in range(8)]
    got = {q.id: q.value for q in G.sample(spark.createDataFrame(points, "id int, x double, y double, z double"), volume(spark, x)).collect()}
    assert all(abs(got[n] - (np.sin(a / 8) + np.cos(b / 9) * np.sin(c / 10))) < 1e-5 for n, a, b, c in points)


def test_rules_and_gaps(spark):
    x = np.arange(8.0).reshape(2, 2, 2)
    p = spark.createDataFrame([(1, 0.2, 0.9, 0.0)], "id int, x double, y double, z double")
    assert G.sample(p, volume(spark, x), "nearest").first().value == 2
    assert G.sample(p, volume(spark, x), "linear").first().value == pytest.approx(0.2 * 4 + 0.9 * 2)
    with pytest.raises(ValueError):
        G.sample(p, volume(spark, x), "sinc")
    with pytest.raises(Exception, match="gaps"):
        G.sample(p, volume(spark, x).where("not (i = 0 and j = 0 and k = 0)")).collect()
    assert G.sample(p, volume(spark, x).limit(0)).first().value is None


def test_transforms(spark):
    x = np.fromfunction(lambda i, j, k: 2.0 * i + 3 * j - k, SHAPE)
    v = volume(spark, x)
    at = [(0, 0, 0, 1.5, 2.0, 3.5), (1, 0, 0, 3.0, 1.0, 0.0), (2, 0, 0, 99.0, 0.0, 0.0)]
    got = {r.i: r.v for r in G.transform("func_to_mni", v, spark.createDataFrame(at, "i int, j int, k int, x double, y double, z double"), "linear", fill=-7).collect()}
    assert got == {0: pytest.approx(5.5), 1: pytest.approx(9.0), 2: -7}
    depths = [("lh", n, d, 1.0 + n, 1.0, 1.0 + d) for n in range(3) for d in range(3)] + [("lh", 3, d, -50.0, 0.0, 0.0) for d in range(3)] + [("rh", 0, 0, 0.0, 0.0, 0.0), ("rh", 0, 1, 77.0, 0.0, 0.0)]
    where = spark.createDataFrame(depths, "hemisphere string, vertex int, depth int, x double, y double, z double")
    onto = spark.createDataFrame([("lh", 0, 2), ("lh", 1, 2), ("lh", 2, 0), ("lh", 3, 3), ("rh", 0, 0), ("rh", 1, 9)], "hemisphere string, vertex int, source int")
    got = {(r.hemisphere, r.vertex): r.v for r in G.transform("func_to_fsaverage", v, where, "linear", onto).collect()}
    assert got == {("lh", 0): 7.0, ("lh", 1): 7.0, ("lh", 2): 3.0, ("lh", 3): None, ("rh", 0): 0.0, ("rh", 1): None}
    flat = where.where("depth = 1").drop("depth")
    got = {(r.hemisphere, r.vertex): r.v for r in G.transform("func_to_surface", v, flat, "nearest").collect()}
    assert got[("lh", 1)] == 5.0 and got[("rh", 0)] is None
    for wrong in (("x", None), ("func_to_mni", onto), ("func_to_fsaverage", None)):
        with pytest.raises(ValueError):
            G.transform(wrong[0], v, flat, correspondence=wrong[1])


def test_neither_points_nor_volumes_are_broadcast(spark, tmp_path):
    """Sizes of exploded rows are guessed from a small file; the plan of the sampling must not trust them."""
    at = str(tmp_path / "rows.parquet")
    spark.range(4).write.parquet(at)
    rows = spark.read.parquet(at)
    v = rows.selectExpr("cast(id as int) as i", "explode(sequence(0, 3)) as j").selectExpr("i", "j", "explode(sequence(0, 3)) as k").selectExpr("*", "cast(i as double) as v")
    points = rows.selectExpr("id", "id * 0.5 as x", "1.0d as y", "2.0d as z").selectExpr("id", "cast(x as double) as x", "y", "z")
    for how in ("nearest", "linear", "cubic"):
        got = G.sample(points, v, how)
        joins = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "[i#" in line]
        assert joins and all("SortMergeJoin" in line for line in joins), how
        assert got.count() == 4
