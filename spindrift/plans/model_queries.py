"""Queries over models: ridge regressions, distributed lags, bilinear maps, decay fits, interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as M
from ..operators import basis as B
from ..operators import decay as D
from ..operators import linear as L
from ..operators import regressors as E
from ..operators import series as S
from . import inputs as I
from .inputs import HOURLY_SQL, MATRIX_SQL, RUNS_SQL
from .registry import query

_HOURS = f"(SELECT run, t, x FROM {RUNS_SQL})"


@query(
    "ridge_one_regressor",
    f"WITH d AS {HOURLY_SQL}, y AS {_HOURS} SELECT y.run AS voxel, CAST(0 AS INTEGER) AS k, round(sum(d.x * y.x) / (any_value(q.s) + 10), 6) AS beta FROM d JOIN y USING (t), (SELECT sum(x * x) AS s FROM d) q GROUP BY y.run",
)
def ridge_one_regressor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event type's hourly series on the series of all events."""
    design = I.hourly(spark, sf_dir).withColumn("k", F.lit(0))
    y = I.runs(spark, sf_dir).withColumnRenamed("run", "voxel")
    return L.ridge(design, y, 10.0, ["t"]).select("voxel", "k", F.round("beta", 6).alias("beta"))


@query(
    "ridge_two_regressors",
    f"""WITH d AS (SELECT t, x / 100 AS a, (t % 24) / 24.0 AS b FROM {HOURLY_SQL}), y AS (SELECT run, t, x / 100 AS y FROM {_HOURS}),
    g AS (SELECT sum(a * a) + 2 AS aa, sum(a * b) AS ab, sum(b * b) + 2 AS bb FROM d),
    p AS (SELECT run, sum(a * y) AS ay, sum(b * y) AS byy FROM d JOIN y USING (t) GROUP BY run)
    SELECT run AS voxel, round((bb * ay - ab * byy) / (aa * bb - ab * ab), 6) AS beta_0, round((aa * byy - ab * ay) / (aa * bb - ab * ab), 6) AS beta_1 FROM p, g""",
)
def ridge_two_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = I.hourly(spark, sf_dir)
    two = d.select("t", F.posexplode(F.array(F.col("x") / 100, (F.col("t") % 24) / 24.0)).alias("k", "x"))
    y = I.runs(spark, sf_dir).select(F.col("run").alias("voxel"), "t", (F.col("x") / 100).alias("x"))
    beta = L.ridge(two, y, 2.0, ["t"]).groupBy("voxel").agg(F.map_from_entries(F.collect_list(F.struct("k", "beta"))).alias("b"))
    return beta.select("voxel", *[F.round(F.element_at("b", k), 6).alias(f"beta_{k}") for k in (0, 1)])


@query(
    "gram_lag",
    f"""WITH s AS {HOURLY_SQL}, l AS (SELECT run, t, x FROM {_HOURS}), j AS (SELECT s.t + k.lag AS t, k.lag, s.x FROM s, range(0, 3) k(lag))
    SELECT CAST(j.lag AS INTEGER) AS lag, l.run, round(sum(j.x * l.x), 3) AS s FROM j JOIN l USING (t) GROUP BY 1, 2""",
)
def gram_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products of three lags of the hourly series with each type's series."""
    s = I.hourly(spark, sf_dir)
    lagged = s.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("lag"), "t", "x").withColumn("t", F.col("t") + F.col("lag"))
    out = L.cross_products(lagged, I.runs(spark, sf_dir), ["t"], "lag", "run")
    return out.select(F.col("i").alias("lag"), F.col("j").alias("run"), F.round("s", 3).alias("s"))


@query(
    "interaction_matrix",
    f"""WITH e AS (SELECT t, voxel AS k, x FROM {MATRIX_SQL} WHERE voxel < 2), p AS (SELECT t, voxel - 2 AS k, x FROM {MATRIX_SQL} WHERE voxel >= 2 AND voxel < 5)
    SELECT e.t, CAST(e.k * 3 + p.k AS INTEGER) AS col, round(e.x * p.x, 6) AS x FROM e JOIN p USING (t)""",
)
def interaction_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir)
    e = m.where("voxel < 2").select("t", F.col("voxel").alias("k"), "x")
    p = m.where("voxel >= 2 and voxel < 5").select("t", (F.col("voxel") - 2).alias("k"), "x")
    return B.interactions(e, p, [], "t").select("t", F.col("col").cast("int").alias("col"), F.round("x", 6).alias("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series with ``n``, the place of each hour that there is: hours without events leave no gap."""
    return S.concat_runs(I.hourly(spark, sf_dir).withColumn("run", F.lit(0)), "run", ["t"], "n")


def lag_design(spark: SparkSession, sf_dir: str, lags: range, df: int, kind: str = "cr") -> DataFrame:
    """The hourly series on a lag basis, complete rows only, each column z-scored: ``t, k, x``."""
    basis = B.basis_table(spark, lags, df, kind)
    s = frames(spark, sf_dir).select("run", F.col("n").alias("t"), "x")
    out = B.project(s, basis, ["run"], "t", "x", len(lags))
    return S.zscore(out, "v", ["k"]).select("t", "k", F.col("z").alias("x"))


@query("dlm_physio")
def dlm_physio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of each type's series to a unit of the hourly series over lags -15 to 15, by a five-column basis."""
    lags = range(-15, 16)
    place = frames(spark, sf_dir).select("t", "n")
    y = S.zscore(I.runs(spark, sf_dir), "x", ["run"]).join(place, "t").select(F.col("run").alias("voxel"), F.col("n").alias("t"), F.col("z").alias("x"))
    beta = L.ridge(lag_design(spark, sf_dir, lags, 5), y, 10_000.0, ["t"])
    return L.predict(beta, B.basis_table(spark, lags, 5)).select("voxel", "lag", F.round("y", 8).alias("y"))


@query("dlm_event")
def dlm_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response of the hourly series to each trial type, all users' events, 15 hours long."""
    e = I.events(spark, sf_dir).select(F.lit("all").alias("run"), "trial_type", (F.col("sec") / 3600).alias("onset"), F.lit(0.0).alias("duration"))
    y = I.hourly(spark, sf_dir).withColumn("run", F.lit("all"))
    design, shapes = E.event_design(y, e, tr=1.0, knots_per_second=0.3, kind="cr", extend=15.0)
    z = S.zscore(y, "x", ["run"]).select("run", "t", F.lit(0).alias("voxel"), F.col("z").alias("x"))
    beta = L.ridge(design, z, 1.0, ["run", "t"])
    return E.evaluate_events(beta, shapes).select("trial_type", "time", F.round("y", 8).alias("y"))


@query("event_regressors")
def event_regressors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.events(spark, sf_dir).select(F.lit("all").alias("run"), "trial_type", (F.col("sec") / 3600).alias("onset"), F.lit(0.0).alias("duration"))
    y = I.hourly(spark, sf_dir).withColumn("run", F.lit("all"))
    return E.event_design(y, e, tr=1.0, knots_per_second=0.3, kind="bs", extend=15.0)[0].withColumn("x", F.round("x", 8))


@query("bilinear_courses")
def bilinear_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time courses of four maps (the first vectors of labels 0 to 3) in all frames."""
    z, _ = bilinear(spark, sf_dir)
    return z.withColumn("z", F.round("z", 6))


@query("bilinear_coefficients")
def bilinear_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a = bilinear(spark, sf_dir)
    return a.withColumn("a", F.round("a", 6))


def bilinear(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..operators.stats import map_norms

    m = I.matrix(spark, sf_dir)
    first = m.where("label < 4").groupBy("label").agg(F.min("t").alias("t"))
    maps = map_norms(m.join(F.broadcast(first), ["t", "label"], "left_semi").select(F.col("label").alias("map"), "voxel", "x"))
    design = m.groupBy("t").agg(F.max("label").alias("l")).select("t", F.posexplode(F.array((F.col("l") % 2).cast("double"), (F.col("t") % 10) / 10.0)).alias("k", "x"))
    return L.bilinear(design, m.select("t", "voxel", "x"), maps, 0.01)


@query("bilinear_map_products", f"WITH f AS (SELECT label, min(vec_id) AS t FROM embeddings WHERE label < 4 GROUP BY 1), m AS (SELECT f.label AS map, voxel, x FROM {MATRIX_SQL} a JOIN f ON a.t = f.t) SELECT a.map AS i, b.map AS j, round(sum(a.x * b.x), 6) AS s FROM m a JOIN m b USING (voxel) GROUP BY 1, 2")
def bilinear_map_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir)
    first = m.where("label < 4").groupBy("label").agg(F.min("t").alias("t"))
    maps = m.join(F.broadcast(first), ["t", "label"], "left_semi").select(F.col("label").alias("map"), "voxel", "x")
    return L.cross_products(maps, maps, ["voxel"], "map", "map").select("i", "j", F.round("s", 6).alias("s"))


ECHOES = (10.6, 28.69, 46.78, 64.87)


def echo_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a decaying signal: four echoes by six times for each supplier's first orders."""
    s = I.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("voxel_id"), (F.abs("s_acctbal") + 500).alias("a"))
    t2 = 20 + F.col("voxel_id") % 40
    series = F.array(*[F.array(*[F.col("a") * (1 + 0.01 * t) * F.exp(-F.lit(te) / (t2 + t)) for t in range(6)]) for te in ECHOES])
    return s.select("voxel_id", series.alias("series"))


@query("decay_fit")
def decay_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = D.fit_decay(D.good_echoes(echo_voxels(spark, sf_dir), 0.01), ECHOES)
    return fits.select("voxel_id", "n_good", F.posexplode_outer("t2star").alias("t", "t2star")).withColumn("t2star", F.round("t2star", 6))


@query(
    "echo_mask",
    f"""WITH m AS (SELECT s_suppkey AS voxel_id, [{", ".join(f"list_avg(list_transform(range(0, 6), lambda t: (abs(s_acctbal) + 500) * (1 + 0.01 * t) * exp(-CAST({te} AS DOUBLE) / (20 + s_suppkey % 40 + t))))" for te in ECHOES)}] AS m FROM supplier)
    SELECT voxel_id, CAST(list_max(list_transform(range(1, 5), lambda i: CASE WHEN m[i] >= m[1] / 3.0 THEN i ELSE 0 END)) AS INTEGER) AS n_good FROM m""",
)
def echo_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.good_echoes(echo_voxels(spark, sf_dir)).select("voxel_id", "n_good")


_MEANS_SQL = ", ".join(f"list_avg(list_transform(range(0, 6), lambda t: (abs(s_acctbal) + 500) * (1 + 0.01 * t) * exp(-CAST({te} AS DOUBLE) / (20 + s_suppkey % 40 + t))))" for te in ECHOES)


@query(
    "adaptive_mask",
    f"""WITH m AS (SELECT s_suppkey AS voxel_id, [{_MEANS_SQL}] AS m FROM supplier),
    r AS (SELECT m, row_number() OVER (ORDER BY m[1]) - 1 AS k, count(*) OVER () AS n FROM m WHERE m[1] <> 0),
    l AS (SELECT m AS least FROM r WHERE m[1] = (SELECT m[1] FROM r WHERE k = ceil(0.33 * (n - 1))) ORDER BY list_sum(m) DESC LIMIT 1),
    g AS (SELECT voxel_id, len(list_filter(range(1, {len(ECHOES) + 1}), lambda i: abs(m[i]) > least[i] / 3)) AS n FROM m, l)
    SELECT voxel_id, CAST(CASE WHEN n >= 2 THEN n ELSE 0 END AS INTEGER) AS n_good FROM g""",
)
def adaptive_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Echoes with signal, by limits from the voxel at the 33rd percentile of the first echo."""
    return D.adaptive_mask(echo_voxels(spark, sf_dir)).select("voxel_id", "n_good")


@query("penalty_sweep")
def penalty_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.good_echoes(echo_voxels(spark, sf_dir), 0.01)
    out = D.sweep(v, ECHOES, (1.0, 3.0), (1.0,))
    return out.select("lambda0", "lambda1", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("penalty_grid", "SELECT l0 AS lambda0, l1 AS lambda1 FROM (VALUES (0.1), (1.0), (3.0), (10.0)) a(l0), (VALUES (0.0), (1.0)) b(l1)")
def penalty_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n, text: spark.createDataFrame([(text,)], "s string").select(F.explode(M.floats(F.col("s"))).alias(n))
    return one("lambda0", "0.1, 1.0,3, 10").crossJoin(one("lambda1", "0,1"))


@query(
    "scalar_functions",
    """SELECT event_id, round(ln(greatest(value, 5.0)), 6) AS log_value, round(CASE WHEN value - 100 > 0 THEN least(500.0, 1000.0 / (value - 100)) END, 6) AS ratio,
      round(atanh(greatest(-1 + 1e-7, least(1 - 1e-7, (value - 245) / 245))), 6) AS z, CAST(trunc((value - 10) / 7.0) AS INTEGER) AS cut, CAST(least(greatest(ceil(value / 3.0), 0), 99) AS INTEGER) AS near,
      round(value / 2.3548, 6) AS sigma, round(greatest(0.0, least(1.0, value / 300)), 6) AS unit, CAST(greatest(3, ceil(value * 0.05)) AS BIGINT) AS n_columns FROM events""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return I.table(spark, sf_dir, "events").select(
        "event_id", F.round(M.clipped_log(v, 5.0), 6).alias("log_value"), F.round(M.capped_ratio(1000.0, v - 100, 500.0), 6).alias("ratio"), F.round(M.fisher_z((v - 245) / 245), 6).alias("z"),
        M.truncated_index(v - 10, 7.0).alias("cut"), M.nearest_index(v, 3.0, 100).alias("near"), F.round(M.fwhm_to_sigma(v), 6).alias("sigma"), F.round(M.clip(v / 300, 0.0, 1.0), 6).alias("unit"),
        F.greatest(F.lit(3).cast("long"), F.ceil(v * 0.05)).alias("n_columns"),
    )


@query(
    "affine_points",
    "SELECT vec_id, round(2.0 * (vec_id % 10) + 0.5 * label - 90, 6) AS x, round(2.0 * label - 126, 6) AS y, round(-0.25 * (vec_id % 10) + 2.0 * (vec_id % 7) - 72, 6) AS z, round((vec_id + 3) * 1.333, 6) AS seconds FROM embeddings",
)
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, label = F.col("vec_id"), F.col("label")
    x, y, z = M.affine([[2.0, 0.5, 0.0, -90.0], [0.0, 2.0, 0.0, -126.0], [-0.25, 0.0, 2.0, -72.0]], [v % 10, label, v % 7])
    return I.table(spark, sf_dir, "embeddings").select("vec_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"), F.round(M.frame_time(3, v, 1.333), 6).alias("seconds"))


@query(
    "hex_colours",
    """WITH h AS (SELECT p_partkey, '#' || substr(md5(p_name), 1, 6) AS h FROM part) SELECT p_partkey, h AS hex,
      """ + ", ".join(f"round((strpos('0123456789abcdef', h[{2 + 2 * k}:{2 + 2 * k}]) * 16 - 16 + strpos('0123456789abcdef', h[{3 + 2 * k}:{3 + 2 * k}]) - 1) / 255.0, 6) AS {c}" for k, c in enumerate("rgb")) + " FROM h",
)
def hex_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labels import hex_colour

    h = I.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.substring(F.md5(F.col("p_name").cast("binary")), 1, 6)).alias("hex"))
    return h.select("p_partkey", "hex", *[F.round(F.get(hex_colour(F.col("hex")), F.lit(k)), 6).alias(c) for k, c in enumerate("rgb")])
