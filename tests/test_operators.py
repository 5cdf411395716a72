"""Kernels, bases, models and readers: invariants, dense solves, errors."""

import base64
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions import kernels as K
from spindrift.functions import scalar as M
from spindrift.operators import basis as B
from spindrift.operators import decay as D
from spindrift.operators import events as E
from spindrift.operators import labels as G
from spindrift.operators import linear as L
from spindrift.operators import regressors as R
from spindrift.operators import series as S
from spindrift.operators import signal as P
from spindrift.operators import spatial, stats
from spindrift.plans import workflows as W
from spindrift.sources import catalog as C
from spindrift.sources import sinks, tables


@settings(max_examples=30, deadline=None)
@given(st.integers(3, 9), st.integers(10, 60))
def test_natural_spline(df, n):
    x = np.arange(-5, n)
    m = B.natural_spline(x, df)
    assert m.shape == (len(x), df) and np.allclose(m.sum(1), 1)
    knots = np.r_[x.min(), np.percentile(x, np.linspace(0, 100, df)[1:-1]), x.max()]
    assert np.allclose(m @ (2 * knots + 1), 2 * x + 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(4, 9))
def test_b_spline(df):
    x = np.linspace(0, 10, 50)
    m = B.b_spline(x, df)
    assert m.shape == (50, df) and (m >= -1e-12).all() and (m.sum(1) <= 1 + 1e-12).all() and np.isclose(m[-1].sum(), 1)


def test_basis_choices():
    assert B.spline_df(30, 1.0, 0.3) == 9 and B.spline_df(2, 1.0, 0.1) == 3 and B.spline_df(30, 1.0, 0.3, 5) == 5
    with pytest.raises(ValueError):
        B.basis_matrix(range(5), 3, "x")
    assert B.basis_matrix(range(10), 99, "cr", [2.0, 5.0]).shape == (10, 4)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=3, max_size=15))
def test_pchip_is_monotone_between_points(y):
    x = np.arange(len(y), dtype=float)
    at = np.linspace(0, len(y) - 1, 200)
    got = K.pchip(x, np.array(y), at)
    k = np.clip(at.astype(int), 0, len(y) - 2)
    lo, hi = np.minimum(np.array(y)[k], np.array(y)[k + 1]), np.maximum(np.array(y)[k], np.array(y)[k + 1])
    assert (got >= lo - 1e-9).all() and (got <= hi + 1e-9).all()


def test_cubic_reproduces_cubics():
    x = np.linspace(0, 3, 9)
    f = lambda v: v**3 - 2 * v + 1
    assert np.allclose(K.cubic(x, f(x), np.linspace(0, 3, 31)), f(np.linspace(0, 3, 31)))


def test_butterworth_gains():
    def gain(sections, f, rate):
        z = np.exp(-2j * np.pi * f / rate)
        out = 1.0
        for s in sections:
            out *= np.polyval(s[2::-1], z) / np.polyval(s[:2:-1], z)
        return abs(out)

    for order in (2, 3, 4, 5):
        low, high, band = K.butterworth(order, 5.0, 50.0), K.butterworth(order, 5.0, 50.0, "high"), K.butterworth(order, (2.0, 8.0), 50.0, "band")
        assert np.isclose(gain(low, 5, 50), 2**-0.5) and np.isclose(gain(high, 5, 50), 2**-0.5)
        assert np.isclose(gain(low, 1e-9, 50), 1) and gain(low, 24.9, 50) < 1e-3 and gain(high, 1e-3, 50) < 1e-3 and np.isclose(gain(high, 25, 50), 1)
        assert np.isclose(gain(band, 2, 50), 2**-0.5) and np.isclose(gain(band, 8, 50), 2**-0.5)
    t = np.arange(2000) / 50
    slow, fast = np.sin(2 * np.pi * 0.5 * t), np.sin(2 * np.pi * 15 * t)
    kept = K.zero_phase(K.butterworth(4, 5.0, 50.0), slow + fast)
    assert np.abs(kept - slow)[100:-100].max() < 0.01
    assert np.allclose(K.zero_phase(K.butterworth(4, 5.0, 50.0), np.full(60, 3.0)), 3.0)


def test_peaks():
    x = np.array([0, 2, 0, 3, 3, 3, 0, 1, 5, 1, 4, 0], float)
    assert K.find_peaks(x).tolist() == [1, 4, 8, 10]
    assert K.find_peaks(x, height=3).tolist() == [4, 8, 10] and K.find_peaks(x, distance=3).tolist() == [1, 4, 8]
    assert K.find_peaks(x, top=2).tolist() == [8, 10] and K.find_peaks(x, prominence=3).tolist() == [4, 8, 10]
    assert K.find_peaks(np.zeros(5)).tolist() == []


def test_series_operators(spark):
    df = spark.createDataFrame([("a", t, float(t % 3)) for t in range(6)] + [("b", t, 7.0) for t in range(3)], "run string, t int, x double")
    z = S.zscore(df, "x", ["run"]).groupBy("run").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).orderBy("run").collect()
    assert abs(z[0].m) < 1e-12 and abs(z[0].s - 1) < 1e-12 and z[1].m == z[1].s == 0
    lags = S.lag_matrix(df, "x", [2, -9], ["run"], ["t"], 0.0).where("run = 'b'").collect()
    assert [r.lag_2 for r in sorted(lags, key=lambda r: r.t)] == [0.0, 0.0, 7.0] and {r.lag_m9 for r in lags} == {0.0}
    assert [r.t_all for r in S.concat_runs(df, "run", ["t"]).orderBy("run", "t").collect()] == list(range(9))
    with pytest.raises(ValueError):
        S.frame_range(df, "t", 5, 3)
    with pytest.raises(Exception, match="trigger"):
        S.trim_trigger(df, "x", ["run"], "t").collect()


def test_boxcar_modes(spark):
    grid = spark.createDataFrame([("a", t) for t in range(8)], "run string, t int")
    events = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2)], "run string, onset int")
    add = [r.box for r in S.boxcar(grid, events, ["run"], "t", "onset", 2).orderBy("t").collect()]
    one = [r.box for r in S.boxcar(grid, events, ["run"], "t", "onset", 2, add=False).orderBy("t").collect()]
    assert add == [0, 2, 3, 1, 0, 0, 0, 0] and one == [0, 1, 2, 0, -1, -1, -1, -1]
    fine = R.impulses(np.array([0.1, 0.1, 0.2]), 8, 0.1, 0.2)
    assert fine.tolist() == [0, 1, 2, 0, -1, -1, -1, -1]


def test_event_average_equals_plain_mean(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=40)
    onsets = [(k % 2, int(o)) for k, o in enumerate(r.integers(-2, 42, 30))]
    series = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "run string, t int, x double")
    events = spark.createDataFrame([("a", f"k{k}", o) for k, o in onsets], "run string, trial_type string, onset int")
    got = {(g.trial_type, g.lag): g.avg_response for g in E.event_average(series, events, ["run"], "t", "x", "onset", 5).collect()}
    for kind in (0, 1):
        kept = [x[o : o + 5] for k, o in onsets if k == kind and o >= 0 and o + 5 <= 40]
        assert np.allclose([got[f"k{kind}", lag] for lag in range(5)], np.mean(kept, 0))
    rows = E.segments(series, events, ["run"], "t", "x", "onset", 5).count()
    assert rows == 5 * sum(o >= 0 and o + 5 <= 40 for _, o in onsets)
    assert spark.range(1).select(E.onset_index(F.lit(-0.4), 1.0)).first()[0] == 0


def test_group_trials(spark):
    rows = [("s", k, o, 1.0, t) for k, (o, t) in enumerate([(0.0, "x"), (1.0, "cue"), (2.0, "y"), (3.0, "cue"), (4.0, "z")])]
    df = spark.createDataFrame(rows, "run string, ix int, onset double, duration double, trial_type string")
    got = E.group_trials(df, ["run"], ["ix"], F.col("trial_type") == "cue").orderBy("trial").collect()
    assert [(g.onset, g.duration, g.trial_type) for g in got] == [(0.0, 1.0, "x"), (1.0, 2.0, "cue"), (3.0, 2.0, "cue")]


def test_ridge_solves_the_normal_equations(spark):
    r = np.random.default_rng(1)
    x, y = r.normal(size=(50, 3)), r.normal(size=(50, 4))
    long = lambda m, c: spark.createDataFrame([("a", int(t), int(k), float(v)) for (t, k), v in np.ndenumerate(m)], f"run string, t int, {c} int, x double")
    got = L.to_matrix(L.ridge(long(x, "k"), long(y, "voxel"), 2.0), "k", "voxel", "beta")
    assert np.allclose(got, np.linalg.solve(x.T @ x + 2 * np.eye(3), x.T @ y))
    assert np.allclose(L.ridge_inverse(np.ones((2, 2)), 0), np.linalg.pinv(np.ones((2, 2))))


def test_bilinear_and_reconstruction(spark):
    r = np.random.default_rng(2)
    x, s, y = r.normal(size=(30, 2)), r.normal(size=(3, 12)), r.normal(size=(30, 12))
    d = spark.createDataFrame([(int(t), int(k), float(v)) for (t, k), v in np.ndenumerate(x)], "t int, k int, x double")
    maps = spark.createDataFrame([(int(t), int(k), float(v)) for (t, k), v in np.ndenumerate(s)], "map int, voxel int, x double")
    out = spark.createDataFrame([(int(t), int(k), float(v)) for (t, k), v in np.ndenumerate(y)], "t int, voxel int, x double")
    z, a = L.bilinear(d, out, maps, 0.5)
    zz = y @ s.T @ np.linalg.inv(s @ s.T + 0.5 * np.eye(3))
    assert np.allclose(L.to_matrix(z, "t", "map", "z"), zz)
    assert np.allclose(L.to_matrix(a, "k", "map", "a"), np.linalg.inv(x.T @ x + 0.5 * np.eye(2)) @ x.T @ zz)
    assert np.allclose(L.to_matrix(L.reconstruct(z, maps), "t", "voxel", "y"), zz @ s)


def test_pca(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(t, v.tolist()) for t, v in enumerate(x)], "t int, v array<double>")
    scores, loadings = L.pca(df, "t", "v", 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = L.to_matrix(scores, "t", "component", "score")
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T)) and np.allclose(loadings.attrs["explained_variance"], s[:2] ** 2 / 39 / 5)


def test_pca_over_time(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(12, 60)) * np.linspace(3, 1, 12)[:, None]
    df = spark.createDataFrame([(v, x[:, v].tolist()) for v in range(60)], "voxel int, ts array<double>")
    scores, loadings = L.pca_time(df, "voxel", "ts", 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(scores["score"].to_numpy().reshape(12, 3)), np.abs(x @ vt[:3].T))
    assert np.allclose(scores.attrs["explained_variance"], s[:3] ** 2 / 11 / 60)
    assert np.allclose(np.abs(L.to_matrix(loadings, "voxel", "component", "loading")), np.abs(vt[:3].T * s[:3]) / np.sqrt(11))


def test_quantile_sketch(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("g"))
    near, exact = (stats.box_stats(df, "x", ["g"], a).first() for a in (10_000, None))
    assert abs(near.median - exact.median) <= 1 and exact.median == 500 and (exact.low, exact.high) == (0.0, 1000.0)


def test_seed_errors(spark):
    m = spark.createDataFrame([(t, v, float(t * v)) for t in range(5) for v in range(3)], "t int, voxel int, x double")
    seed = m.where("voxel = 1").select("t", F.col("x").alias("s"))
    got = {r.voxel: r.r for r in L.seed_map(m, seed).collect()}
    assert got[0] is None and got[2] == pytest.approx(1.0)
    with pytest.raises(Exception, match="variance"):
        L.seed_map(m, seed.withColumn("s", F.lit(1.0))).collect()
    with pytest.raises(ValueError):
        L.seed_map(m, seed, "x")
    assert {r.r for r in L.seed_map(m.where("t = 0"), seed, "covariance").collect()} == {0.0}


def test_decay_fit_recovers_and_caps(spark):
    te = (10.0, 25.0, 40.0)
    t2 = np.array([20.0, 60.0, 5e6])
    series = [[[float(1000 * np.exp(-e / v))] * 5 for e in te] for v in t2]
    df = spark.createDataFrame([(k, n, s) for k, (s, n) in enumerate(zip(series, (3, 2, 3)))] + [(9, 1, series[0]), (10, 3, [[1.0] * 5, [2.0] * 5, [3.0] * 5]), (11, 3, [[float("nan")] * 5] * 3)], "voxel_id long, n_good int, series array<array<double>>")
    got = {r.voxel_id: r for r in D.fit_decay(df, te).collect()}
    assert np.allclose(got[0].t2star, 20) and np.allclose(got[1].t2star, 60) and np.allclose(got[2].t2star, 500) and np.allclose(got[0].s0, 1000)
    assert got[9].t2star is None and got[11].t2star is None and set(got[10].t2star) == {None}
    for bad in ((10.0,), (0.01, 0.02), (20.0, 10.0), (-1.0, 5.0)):
        with pytest.raises(ValueError):
            D.check_echo_times(bad)


def test_decay_fit_is_the_dense_solve():
    r = np.random.default_rng(5)
    y, te, n = np.exp(r.normal(size=(2, 3, 6))), np.array([1.0, 2.5, 4.0]), 6
    s0, t2 = D.fit_series(y, te, 3.0, 1.0, rescale=1.0, cap=1e9)
    design = np.vstack([np.hstack([np.eye(n), -e * np.eye(n)]) for e in te])
    d = np.diff(np.eye(n), 2, axis=0)
    penalty = np.vstack([np.hstack([np.sqrt(3) * d, np.zeros_like(d)]), np.hstack([np.zeros_like(d), d])])
    for k in range(2):
        x = np.linalg.lstsq(np.vstack([design, penalty]), np.r_[np.log(y[k]).ravel(), np.zeros(2 * len(d))], rcond=None)[0]
        assert np.allclose(np.log(s0[k]), x[:n])
        assert np.allclose(np.where(x[n:] > 0, 1 / x[n:], np.nan), t2[k], equal_nan=True)


def test_clean_voxels(spark):
    t = np.arange(200)
    rows = [(1, (np.sin(t / 3) + t * 0.1).tolist()), (2, [4.0] * 200), (3, [1.0] * 5)]
    got = {r.voxel_id: np.array(r.ts) for r in P.clean_voxels(spark.createDataFrame(rows, "voxel_id int, ts array<double>"), 1.5, trim=10).collect()}
    assert len(got[1]) == 190 and abs(got[1].mean()) < 1e-9 and abs(got[1].std() - 1) < 1e-9 and not got[2].any() and len(got[3]) == 0


def test_smoothing_equals_the_whole_kernel(spark):
    r = np.random.default_rng(4)
    cells = {tuple(int(v) for v in c): float(x) for c, x in zip(r.integers(0, 7, (60, 3)), r.random(60))}
    got = P.smooth(spark.createDataFrame([(*c, x) for c, x in cells.items()], "i int, j int, k int, x double"), 4.0, 2.0).collect()
    sigma = 4.0 / 2.3548 / 2.0
    for q in got:
        near = [(np.exp(-sum((a - b) ** 2 for a, b in zip(c, (q.i, q.j, q.k))) / (2 * sigma**2)), x) for c, x in cells.items() if max(abs(a - b) for a, b in zip(c, (q.i, q.j, q.k))) <= 3]
        assert abs(q.x - sum(w * x for w, x in near) / sum(w for w, _ in near)) < 1e-12
    assert len(got) == len(cells)


def test_kept_events(spark):
    e = spark.createDataFrame([("a", 3), ("a", 3), ("a", 9), ("a", -1), ("b", 4), ("b", None)], "trial_type string, t int")
    assert sorted(map(tuple, E.kept_events(e, "t", 6, 10).collect())) == [("a", 3, 2), ("b", 4, 1)]


def test_smoothing_keeps_a_constant(spark):
    v = spark.createDataFrame([(i, j, k, 3.0) for i in range(4) for j in range(4) for k in range(2)], "i int, j int, k int, x double")
    assert all(abs(r.x - 3) < 1e-12 for r in P.smooth(v, 4.0, 2.0).collect()) and P.smooth(v, 0.0, 2.0) is v


def test_sampling(spark):
    v = spark.createDataFrame([(i, j, k, float(i + 10 * j + 100 * k)) for i in range(3) for j in range(3) for k in range(3)], "i int, j int, k int, v double")
    p = spark.createDataFrame([(1, 0.5, 1.25, 1.0), (2, 2.0, 2.0, 2.0), (3, 2.5, 0.0, 0.0)], "id int, x double, y double, z double")
    got = {r.id: r.value for r in spatial.linear(p, v).collect()}
    assert got == {1: pytest.approx(113.0), 2: pytest.approx(222.0), 3: None}
    assert {r.id: r.value for r in spatial.nearest(p, v).collect()} == {1: 110.0, 2: 222.0, 3: 2.0}


def test_labels(spark):
    names = spark.createDataFrame([(1, "Precentral_L"), (2, "Postcentral_R"), (3, "Insula")], "key int, name string")
    assert [r.key for r in G.find_keys(names, ["central"], "contains").collect()] == [1, 2]
    with pytest.raises(ValueError, match="Insula"):
        G.find_keys(names, ["nowhere"])
    df = spark.createDataFrame([(1, 2.5), (2, 3.5), (3, 2.0)], "vertex int, label double")
    assert {r.vertex: r.in_roi for r in G.roi_mask(df, names.where("key = 2")).collect()} == {1: True, 2: False, 3: True}
    one = spark.createDataFrame([("#ff8000",), ("00ff0080",), ("red",)], "c string").select(G.hex_colour(F.col("c")).alias("v")).collect()
    assert one[0].v == pytest.approx([1, 128 / 255, 0, 1]) and one[1].v[3] == pytest.approx(128 / 255) and one[2].v is None
    with pytest.raises(ValueError):
        stats.check_percentiles(50, 50)


def test_readers(spark, tmp_path):
    (tmp_path / "on.1D").write_text("1.5 3 4\n")
    (tmp_path / "du.1D").write_text("1 1 2\n")
    (tmp_path / "bad.1D").write_text("1 1\n")
    got = tables.timing(spark, str(tmp_path / "on.1D"), str(tmp_path / "du.1D"), "c").orderBy("onset").collect()
    assert [(r.onset, r.duration) for r in got] == [(1.5, 1.0), (3.0, 1.0), (4.0, 2.0)]
    with pytest.raises(Exception, match="differ"):
        tables.timing(spark, str(tmp_path / "on.1D"), str(tmp_path / "bad.1D"), "c").collect()
    pair = tables.paired_timing(spark.createDataFrame([("1.5:2 -1:0 3:1",)], "value string"), "c").collect()
    assert [(r.onset, r.duration) for r in pair] == [(1.5, 2.0), (3.0, 1.0)]
    frame = tables.event_frame([tables.timing(spark, str(tmp_path / "on.1D"), str(tmp_path / "du.1D"), k) for k in "ba"], "01").collect()
    assert [r.trial_type for r in frame[:2]] == ["a", "b"] and frame[0].session == "01"
    (tmp_path / "rec.tsv").write_text("".join(f"{v}\t{k}\n" for k, v in enumerate([0, 5.1, 0, 4.9, 0])))
    (tmp_path / "rec.json").write_text('{"Columns": ["trigger", "cardiac"], "SamplingFrequency": 100}')
    rec, rate = tables.read_triggered(spark, str(tmp_path / "rec.tsv"), str(tmp_path / "rec.json"), ["cardiac"])
    assert rate == 100 and [r.cardiac for r in rec.orderBy("ix").collect()] == [1.0, 2.0]
    with pytest.raises(ValueError, match="missing"):
        tables.read_triggered(spark, str(tmp_path / "rec.tsv"), str(tmp_path / "rec.json"), ["missing"])
    (tmp_path / "none.json").write_text('{"Columns": ["a"]}')
    with pytest.raises(ValueError):
        tables.sidecar(spark, str(tmp_path / "none.json"))
    (tmp_path / "a.tsv").write_text("1\n2\n3\n")
    (tmp_path / "b.tsv").write_text("4\n5\n")
    both, _ = tables.read_pair(spark, str(tmp_path / "a.tsv"), str(tmp_path / "b.tsv"))
    assert [(r.cardiac, r.respiratory_effort) for r in both.orderBy("ix").collect()] == [(1.0, 4.0), (2.0, 5.0), (3.0, None)]
    tables.write_physio(both.select("cardiac").orderBy("ix"), str(tmp_path / "out"))
    assert tables.read_physio(spark, str(tmp_path / "out"), ["cardiac"], normalise=True).count() == 3
    lines = spark.createDataFrame([("1\tLeft\t#ff0000",), ("2,Right",), ("x,bad",), ("3",)], "value string")
    assert {(r.key, r.name) for r in tables.label_map(lines).collect()} == {(1, "Left"), (2, "Right")}


def test_image_readers(spark, tmp_path):
    x = np.arange(2 * 3 * 2 * 4, dtype="<f4").reshape(2, 3, 2, 4, order="F")
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 4, 2, 3, 2, 4, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
    raw = bytes(head) + x.tobytes(order="F")
    gz = zlib.compressobj(wbits=31)
    (tmp_path / "v.nii.gz").write_bytes(gz.compress(raw) + gz.flush())
    got = {(r.i, r.j, r.k): r.ts for r in tables.read_nifti(spark, str(tmp_path / "v.nii.gz")).collect()}
    assert len(got) == 12 and got[1, 2, 1] == x[1, 2, 1].tolist()
    mask = spark.createDataFrame([(0, 0, 0), (1, 2, 1)], "i int, j int, k int")
    assert sorted(r.voxel_id for r in tables.masked(tables.read_nifti(spark, str(tmp_path / "v.nii.gz")), mask).collect()) == [0, 1]
    data = base64.b64encode(zlib.compress(np.array([0, 2, 5], "<i4").tobytes())).decode()
    (tmp_path / "a.label.gii").write_text(f'<GIFTI><LabelTable><Label Key="2">two</Label></LabelTable><DataArray DataType="NIFTI_TYPE_INT32" Encoding="GZipBase64Binary" Endian="LittleEndian"><Data>{data}</Data></DataArray></GIFTI>')
    v = tables.read_gifti(spark, str(tmp_path / "a.label.gii"))
    assert [r.value for r in v.orderBy("vertex").collect()] == [0.0, 2.0, 5.0]
    assert [r.in_mask for r in tables.vertex_mask(v).orderBy("vertex").collect()] == [False, True, True]
    assert [(r.key, r.name) for r in tables.read_gifti_labels(spark, str(tmp_path / "a.label.gii")).collect()] == [(2, "two")]


def test_catalog(spark):
    paths = ["d/sub-1_ses-01_task-rest_run-01_echo-1_bold.nii.gz", "d/sub-1_ses-01_task-rest_run-01_echo-2_bold.nii.gz", "d/sub-10_ses-01_task-rest_run-01_desc-preproc_bold.nii.gz"]
    f = C.parse(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert C.select(f, sub="1").count() == 2 and [r.sub for r in C.subjects(f).collect()] == ["1", "10"]
    assert C.functional(f, "rest", "preproc", ".nii.gz").count() == 1 and C.functional(f, "rest", None, ".nii.gz").count() == 0
    with pytest.raises(Exception, match="expected 1"):
        C.one_each(f, ["sub"]).collect()
    with pytest.raises(Exception, match="echoes"):
        C.echo_sets(f, 3).collect()
    with pytest.raises(Exception, match="several"):
        C.match_runs(f, f, ("sub", "ses", "task", "run")).collect()
    with pytest.raises(Exception, match="unexpected"):
        C.parse_fixed(f).collect()
    with pytest.raises(Exception, match="unknown task"):
        f.select(C.repetition_time(F.lit("sleep"))).collect()
    with pytest.raises(Exception, match="without events"):
        f.select(C.run_letter(F.lit("03"))).collect()
    t = spark.createDataFrame([("x/sub-1_ses-1_task-simon_cong_onset.1D",), ("x/sub-1_ses-1_task-simon_cong_duration.1D",), ("x/sub-1_ses-1_task-simon_incong_onset.1D",)], "path string")
    parsed = C.parse(t)
    assert C.timing_pairs(parsed.where("path not like '%incong%'")).first().condition == "cong"
    with pytest.raises(Exception, match="pair"):
        C.timing_pairs(parsed).collect()


def test_scalar_guards(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (-1.0,)], "x double")
    got = df.select(M.clip(F.col("x"), 0.0, 1.0).alias("c"), M.capped_ratio(10.0, F.col("x"), 3.0).alias("r"), M.fisher_z(F.col("x")).alias("z")).collect()
    assert got[0].c is None and np.isnan(got[1].c) and got[2].c == 1.0 and got[3].c == 0.0
    assert got[0].r is None and got[2].r == 3.0 and got[3].r is None and got[0].z is None and got[1].z is None
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([("1,-2",)], "s string").select(M.floats(F.col("s"))).collect()


def test_workflows(spark, tmp_path):
    r = np.random.default_rng(6)
    func = [(f"r{k}", "rest", "01", v, r.normal(size=60).cumsum().tolist()) for k in range(2) for v in range(4)]
    spark.createDataFrame(func, "run_id string, task string, ses string, voxel_id long, ts array<double>").write.partitionBy("task", "ses").parquet(str(tmp_path / "study/func"))
    physio = [(f"r{k}", "rest", "01", t, float(v)) for k in range(3) for t, v in enumerate(r.normal(size=50))]
    spark.createDataFrame(physio, "run_id string, task string, ses string, ix int, heart_rate double").write.partitionBy("task", "ses").parquet(str(tmp_path / "study/physio"))
    events = [("r0", "rest", "01", 5.0, 1.0, "go"), ("r1", "rest", "01", 9.0, 1.0, "stop")]
    spark.createDataFrame(events, "run_id string, task string, ses string, onset double, duration double, trial_type string").write.partitionBy("task", "ses").parquet(str(tmp_path / "study/events"))
    study, out = str(tmp_path / "study"), str(tmp_path / "out")
    W.preprocess(spark, study, out, "rest", 1.5)
    assert {len(x.ts) for x in spark.read.parquet(f"{out}/func").collect()} == {50}
    spark.read.parquet(f"{study}/physio").write.partitionBy("task", "ses").parquet(f"{out}/physio")
    spark.read.parquet(f"{study}/events").write.partitionBy("task", "ses").parquet(f"{out}/events")
    for analysis in W.ANALYSES:
        W.analyse(spark, out, f"{out}/results", "rest", analysis, 1.5, ["heart_rate"])
    assert spark.read.parquet(f"{out}/results/rest_heart_rate/values").count() == 31 * 4
    assert spark.read.parquet(f"{out}/results/rest_events/values").select("trial_type").distinct().count() == 2
    assert spark.read.json(f"{out}/results/rest_pca/about").first().analysis == "pca"
    with pytest.raises(ValueError):
        W.load(spark, study, "func", "rest", ["99"])
    with pytest.raises(ValueError):
        W.analyse(spark, study, out, "rest", "x", 1.5)


def test_sinks(spark, tmp_path):
    model = spark.createDataFrame([(0, "left", 5), (1, "right", 9)], "voxel_id int, structure string, vertex int")
    values = spark.createDataFrame([(0, 0, 1.5), (1, 0, 2.5)], "voxel_id int, t int, x double")
    assert sinks.to_surface(values, model).schema["x"].dataType.simpleString() == "float"
    with pytest.raises(Exception, match="brain model"):
        sinks.to_surface(values.union(values.select(F.lit(7), "t", "x")), model).collect()
    sinks.write_matrix(values.withColumn("run_id", F.lit("a")), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).where("run_id = 'a'").count() == 2
    sinks.write_csv(values, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_streaming_bins_equal_batch(spark, tmp_path, data):
    from spindrift.streaming import binned as T

    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    q = T.write_bins(T.binned(T.read_events(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    whole = spark.read.parquet(str(tmp_path / "in")).groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.avg("value").alias("y"), F.count("*").alias("m"))
    both = got.join(whole, ["start", "event_type"]).where("abs(x - y) < 1e-9 and n = m").count()
    assert both == got.count() > 0 and whole.count() - got.count() <= 20


def test_condition_file_and_json_labels(spark):
    from spindrift.sources import catalog as C
    from spindrift.sources import tables

    f = spark.createDataFrame([("x/a_cong_onset.1D",), ("x/a_left_onset.1D",), ("x/b_left_onset.1D",)], "path string")
    assert C.condition_file(f, "cong").first().path == "x/a_cong_onset.1D"
    for bad in ("left", "none"):
        with pytest.raises(Exception, match="files for condition"):
            C.condition_file(f, bad).collect()
    got = {r.key: r for r in tables.label_map_json('{"1": "Left", "2": {"name": "Right", "color": [255, 0, 0]}, "x": "gone", "3": {"color": "#fff000"}}', spark).collect()}
    assert set(got) == {1, 2, 3} and got[1].name == "Left" and got[2].rgba[0] == 1.0 and got[3].colour == "#fff000"
    listed = tables.label_map_json('[{"id": 4, "name": "Up"}, {"name": "none"}, 7]', spark).collect()
    assert [(r.key, r.name) for r in listed] == [(4, "Up")]


def test_trigger_rounds_half_to_even(spark):
    from spindrift.operators import series as S

    rows = [("r", k, v) for k, v in enumerate([4.5, 4.6, 5.5, 5.4, 5.6])]
    got = S.trim_trigger(spark.createDataFrame(rows, "run string, ix int, trigger double"), "trigger", ["run"], "ix").collect()
    assert sorted(r.ix for r in got) == [1, 2]


def test_match_runs_with_missing_keys(spark):
    f = spark.createDataFrame([("f1", "1", "1", "a", "1"), ("f2", "1", "2", "a", "1"), ("f3", "2", "1", "b", "1"), ("f4", "3", "1", "b", "1")], "path string, sub string, ses string, task string, run string")
    p = spark.createDataFrame([("p1", "1", "1", "a", "1"), ("p2", "1", "2", "a", None), ("p3", "2", None, "b", None)], f.schema)
    assert sorted((r.path, r.matched) for r in C.match_runs(f, p).collect()) == [("f1", "p1"), ("f2", "p2"), ("f3", "p3")]


def test_banded_factor_solves_long_series():
    r, te, n = np.random.default_rng(8), np.array([1.0, 2.2, 3.1]), 301
    d = np.diff(np.eye(n), 2, axis=0)
    a = np.block([[3 * np.eye(n) + 3 * d.T @ d, -te.sum() * np.eye(n)], [-te.sum() * np.eye(n), (te @ te) * np.eye(n) + 0.5 * d.T @ d]])
    turns = np.arange(2 * n).reshape(2, n).T.ravel()
    b = r.normal(size=(2 * n, 4))
    assert np.allclose(D._solve(D._factor(tuple(te), n, 3.0, 0.5), b), np.linalg.solve(a[np.ix_(turns, turns)], b))
    for few in (1, 2):
        assert np.isfinite(D.fit_series(np.ones((2, 3, few)), te, 3.0, 1.0)[0]).all()


def test_stages_and_transforms(spark):
    stem = "/d/sub-1_ses-2_task-rest_run-03"
    names = ["_desc-preproc_bold.nii.gz", "_desc-preprocfinal_bold.nii.gz", "_desc-preproct2_bold.nii.gz", "_bold.dtseries.nii", "_desc-s0_bold.dtseries.nii", "_echo-1_desc-preproc_bold.nii.gz", "_physio.tsv.gz", "_desc-preproc_physio.tsv.gz", "_space-MNI_boldref.nii.gz"]
    extra = ["/d/sub-1_ses-2_task-rest_run-03_from-boldref_to-T1w_mode-image_desc-coreg_xfm.txt", "/d/anat/sub-1_from-T1w_to-MNI_mode-image_xfm.h5"]
    files = C.parse(spark.createDataFrame([(stem + n,) for n in names] + [(e,) for e in extra], "path string"))
    ending = lambda df: [r.path[len(stem) :] for r in df.collect()]
    assert ending(C.functional_stage(files, "rest")) == names[:1]
    assert ending(C.functional_stage(files, "rest", "final", sessions=["2"])) == names[1:2]
    assert ending(C.functional_stage(files, "rest", series="t2")) == names[2:3]
    assert ending(C.functional_stage(files, "rest", kind="surface")) == names[3:4]
    assert ending(C.functional_stage(files, "rest", kind="surface", series="s0")) == names[4:5]
    assert ending(C.physio_stage(files, "rest")) == names[6:7] and ending(C.physio_stage(files, "rest", "final")) == names[7:8]
    for wrong in (dict(stage="x"), dict(series="t3"), dict(sessions=["9"])):
        with pytest.raises(ValueError):
            C.functional_stage(files, "rest", **wrong)
    assert C.single_echoes(C.functional_stage(files, "rest")).first().paths == [stem + names[0]]
    runs = spark.createDataFrame([("1", "2", "rest", "03")], "sub string, ses string, task string, run string")
    got = C.transforms(runs, files, "MNI").first()
    assert (got.reference, got.to_anatomy, got.to_space) == (stem + names[8], *extra)
    with pytest.raises(Exception, match="found 0"):
        C.transforms(runs, files.where("to_date(null) is null and suffix <> 'boldref'"), "MNI").collect()
    with pytest.raises(Exception, match="found 2"):
        C.transforms(runs, files.unionByName(files.where("suffix = 'boldref'")), "MNI").collect()
    paths = spark.createDataFrame([("a_echo-1_desc-preproc_bold.nii.gz",)], "p string")
    assert tuple(paths.select(M.decay_name(F.col("p"), "t2").alias("a"), M.decay_name(F.col("p"), "s0", "MNI").alias("b")).first()) == ("a_desc-preproct2_bold.nii.gz", "a_space-MNI_desc-preprocs0_bold.nii.gz")


def test_gifti_round_trip(spark, tmp_path):
    rows = [(n, t, v, float(10 * t + v) if v else None) for n in ("lh", "rh") for t in range(12) for v in range(5)]
    sinks.write_gifti(spark.createDataFrame(rows, "name string, t int, vertex int, x double").repartition(3), str(tmp_path / "s"), series=True)
    back = tables.read_gifti(spark, str(tmp_path / "s" / "name=rh" / "*.txt")).collect()
    assert len(back) == 60 and all(r.value is None if r.vertex == 0 else r.value == 10 * r.array + r.vertex for r in back)
    mask = spark.createDataFrame([(0, True), (1, False)], "vertex int, in_mask boolean")
    sinks.write_roi_pair(mask, mask.where("vertex = 0"), str(tmp_path / "m"))
    assert [r.value for r in tables.read_gifti(spark, str(tmp_path / "m" / "name=L" / "*.txt")).orderBy("vertex").collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="gaps"):
        sinks.write_roi_pair(mask, mask.where("vertex = 1"), str(tmp_path / "n"))


def test_draws(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(40)] + [(99, float("nan")), (98, None), (97, float("inf"))], "id int, x double")
    got = [r.x for r in stats.draws(df, "x", ["id"], 400).orderBy("draw").collect()]
    assert len(got) == 400 and set(got) == set(map(float, range(40))) and got == [r.x for r in stats.draws(df.repartition(5), "x", ["id"], 400).orderBy("draw").collect()]
    assert max(got.count(x) for x in set(got)) < 40
    assert stats.draws(df.where("id > 90"), "x", ["id"]).count() == 0


def test_multiecho(spark, tmp_path):
    te, t2 = (10.0, 25.0, 40.0), np.array([[30.0, 60.0], [45.0, 20.0]])
    for run in ("01", "02"):
        for e, t in enumerate(te, 1):
            x = np.repeat(1000 * np.exp(-t / t2)[:, :, None, None], 6, axis=3).astype("<f4")
            head = bytearray(352)
            struct.pack_into("<i", head, 0, 348)
            struct.pack_into("<8h", head, 40, 4, 2, 2, 1, 6, 1, 1, 1)
            struct.pack_into("<h", head, 70, 16)
            struct.pack_into("<3f", head, 108, 352.0, 0.0, 0.0)
            gz = zlib.compressobj(wbits=31)
            (tmp_path / f"sub-1_ses-2_task-rest_run-{run}_echo-{e}_desc-preproc_bold.nii.gz").write_bytes(gz.compress(bytes(head) + x.tobytes(order="F")) + gz.flush())
    files = C.parse(C.listing(spark, str(tmp_path), "*.nii.gz"))
    mask = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 0)], "i int, j int, k int")
    maps = W.multiecho(spark, files, mask, "rest", te)
    got = {(r.run, r.i, r.j): r for r in maps.collect()}
    assert len(got) == 8 and np.allclose(got["01", 0, 1].t2star, 60, rtol=1e-4) and np.allclose(got["02", 1, 0].t2star, 45, rtol=1e-4)
    assert np.allclose(got["01", 0, 0].s0, 1000, rtol=1e-4) and got["02", 1, 1].s0 == [0.0] * 6 and got["02", 1, 1].t2star == [0.0] * 6
    W.write_multiecho(maps, str(tmp_path / "out"), "MNI")
    assert {r.name for r in spark.read.parquet(str(tmp_path / "out")).select("name").distinct().collect()} == {f"sub-1_ses-2_task-rest_run-{r}_space-MNI_desc-preproc{k}_bold.nii.gz" for r in ("01", "02") for k in ("t2", "s0")}
    with pytest.raises(Exception, match="echoes"):
        W.multiecho(spark, files, mask, "rest", te[:2]).collect()
    with pytest.raises(ValueError):
        W.multiecho(spark, files, mask, "motor", te)


def test_adaptive_mask(spark):
    """Limits of each run from the voxel at the 33rd percentile of its first echo, against a plain version."""
    r = np.random.default_rng(12)
    means = {run: np.abs(r.normal(size=(40, 3))) * [3, 2, 1] for run in ("a", "b")}
    means["a"][:5, 0], means["b"][7:9, 0] = 0, means["b"][6, 0]
    rows = [(run, v, [[float(e) - 0.5, float(e) + 0.5] for e in m]) for run, x in means.items() for v, m in enumerate(x)] + [("c", 0, [[0.0], [1.0], [1.0]])]
    got = {(q.run, q.voxel_id): q.n_good for q in D.adaptive_mask(spark.createDataFrame(rows, "run string, voxel_id int, series array<array<double>>"), by=["run"]).collect()}
    assert len(got) == 81 and got["c", 0] == 0
    for run, x in means.items():
        first = np.sort(x[x[:, 0] != 0, 0])
        at = x[x[:, 0] == first[int(np.ceil(0.33 * (len(first) - 1)))]]
        n = (x > at[at.sum(1).argmax()] / 3).sum(1)
        assert [got[run, v] for v in range(40)] == np.where(n >= 2, n, 0).tolist()


def test_regressors_at_frames_equal_a_spline_each():
    """All frames at once, as a cubic through seven points of the fine grid for each of them."""
    r = np.random.default_rng(4)
    box, weights, grid = (r.random(300) < 0.05).cumsum() % 3.0, r.normal(size=(40, 3)), 0.01
    frames = np.sort(r.uniform(-0.02, 3.0, 50))
    got = R.box_regressors(box, frames, weights, grid)
    fine = np.stack([np.convolve(box, w)[:300] for w in weights.T], axis=1)
    for f, row in zip(frames, got):
        lo = int(np.clip(round(f / grid) - 3, 0, 293))
        near = np.arange(lo, lo + 7)
        assert np.allclose(row, [K.cubic(near * grid, fine[near, c], np.array([f]))[0] for c in range(3)])


def test_ridge_of_series_equals_ridge_of_rows(spark):
    r = np.random.default_rng(6)
    design = spark.createDataFrame([(run, t, k, float(r.normal())) for run, n in (("a", 20), ("b", 31)) for t in range(2, n) for k in range(3)], "run string, t int, k int, x double")
    voxels = spark.createDataFrame([(run, v, r.normal(size=n).tolist()) for run, n in (("a", 20), ("b", 30), ("c", 5)) for v in range(4)], "run string, voxel long, ts array<double>")
    rows = voxels.select("run", "voxel", F.posexplode("ts").alias("t", "x"))
    wanted = {(q.voxel, q.k): q.beta for q in L.ridge(design, rows, 1.5).collect()}
    for most in (L.DESIGN_CELLS, 10):
        got = {(q.voxel, q.k): q.beta for q in L.ridge_series(design, voxels, 1.5, most).collect()}
        assert set(got) == set(wanted) and all(got[k] == pytest.approx(v, abs=1e-10) for k, v in wanted.items())
