"""Queries over the embedding matrix: global signal, seeds, cross products, norms, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import linear as L
from ..operators import series as S
from ..operators import stats as A
from . import inputs as I
from .inputs import MATRIX_SQL, RUNS_SQL
from .registry import query

ROI = range(8)


def roi(spark: SparkSession) -> DataFrame:
    return spark.range(len(ROI)).select(F.col("id").cast("int").alias("voxel"))


for _how, _sql in (("mean", "avg(x)"), ("median", "median(x)")):

    @query(f"global_signal_{_how}", f"SELECT t, round({_sql}, 6) AS gs FROM {MATRIX_SQL} GROUP BY t")
    def _global(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return A.global_signal(I.matrix(spark, sf_dir), how).withColumn("gs", F.round("gs", 6))


@query("global_signal_z", f"WITH g AS (SELECT t, avg(x) AS gs FROM {MATRIX_SQL} GROUP BY t) SELECT t, round((gs - avg(gs) OVER ()) / stddev_pop(gs) OVER (), 6) AS z FROM g")
def global_signal_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = A.global_signal(I.matrix(spark, sf_dir)).withColumn("run", F.lit(0))
    return S.zscore(g, "gs", ["run"]).select("t", F.round("z", 6).alias("z"))


@query("roi_mean", f"SELECT t, round(avg(x), 6) AS gs FROM {MATRIX_SQL} WHERE voxel < {len(ROI)} GROUP BY t")
def roi_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.global_signal(I.matrix(spark, sf_dir), mask=roi(spark)).withColumn("gs", F.round("gs", 6))


_SEED = f"WITH m AS {MATRIX_SQL}, s AS (SELECT t, avg(x) AS s FROM m WHERE voxel < {len(ROI)} GROUP BY t), j AS (SELECT voxel, x, s FROM m JOIN s USING (t))"


@query("seed_correlation", f"{_SEED} SELECT voxel, round(greatest(-1, least(1, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0))), 6) AS r FROM j GROUP BY voxel")
def seed_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir)
    return L.seed_map(m, L.roi_seed(m, roi(spark))).select("voxel", F.round("r", 6).alias("r"))


@query("seed_correlation_fisher", f"{_SEED}, r AS (SELECT voxel, greatest(-1 + 1e-7, least(1 - 1e-7, covar_pop(x, s) / nullif(stddev_pop(x) * stddev_pop(s), 0))) AS r FROM j GROUP BY voxel) SELECT voxel, round(atanh(r), 6) AS z FROM r")
def seed_correlation_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir)
    return L.seed_map(m, L.roi_seed(m, roi(spark)), fisher=True).select("voxel", F.round("r", 6).alias("z"))


@query("seed_covariance", f"{_SEED} SELECT voxel, round(coalesce(covar_samp(x, s), 0), 6) AS r FROM j GROUP BY voxel")
def seed_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir)
    return L.seed_map(m, L.roi_seed(m, roi(spark)), "covariance").select("voxel", F.round("r", 6).alias("r"))


@query("seed_component")
def seed_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation with the region's first principal component."""
    m = I.matrix(spark, sf_dir)
    return L.seed_map(m, L.roi_seed(m, roi(spark), "pca")).select("voxel", F.round("r", 6).alias("r"))


@query("gram_voxel", f"WITH m AS {MATRIX_SQL} SELECT a.voxel AS i, b.voxel AS j, round(sum(a.x * b.x), 4) AS s FROM m a JOIN m b USING (t) GROUP BY 1, 2")
def gram_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "embeddings").select("embedding")
    return L.gram(rows, "embedding").select("i", "j", F.round("s", 4).alias("s"))


@query("gram_time", f"WITH m AS (SELECT t // 24 AS day, t % 24 AS h, run, x / 97 AS x FROM {RUNS_SQL}) SELECT a.day AS i, b.day AS j, round(sum(a.x * b.x), 6) AS s FROM m a JOIN m b USING (run, h) GROUP BY 1, 2")
def gram_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products of the days of all events: a day's voxels are its hours by event type.

    Means of a few amounts have few decimals; divided by 97 no product lies half-way between two rounded ones.
    """
    m = I.runs(spark, sf_dir).withColumns({"day": F.floor(F.col("t") / 24), "h": F.col("t") % 24, "x": F.col("x") / 97})
    return L.cross_products(m, m, ["run", "h"], "day", "day").select("i", "j", F.round("s", 6).alias("s"))


@query("column_moments", f"SELECT voxel, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM {MATRIX_SQL} GROUP BY voxel")
def column_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.column_moments(I.matrix(spark, sf_dir)).select("voxel", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


for _how, _norm in (("l2", "sqrt(sum(x * x) OVER w)"), ("maxabs", "max(abs(x)) OVER w")):

    @query(f"map_norms_{_how}", f"SELECT t AS map, voxel, round(x / greatest({_norm}, 1e-12), 6) AS x FROM {MATRIX_SQL} WINDOW w AS (PARTITION BY t)")
    def _norms(spark: SparkSession, sf_dir: str, how: str = _how) -> DataFrame:
        return A.map_norms(I.matrix(spark, sf_dir).select(F.col("t").alias("map"), "voxel", "x"), how).select("map", "voxel", F.round("x", 6).alias("x"))


@query("nan_count", f"SELECT voxel, count(*) FILTER (WHERE isnan(y) OR isinf(y)) AS n_bad, count(*) AS n FROM (SELECT voxel, CASE WHEN x > 0.3 THEN CAST('nan' AS DOUBLE) ELSE x END AS y FROM {MATRIX_SQL}) GROUP BY voxel")
def nan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir).withColumn("y", F.when(F.col("x") > 0.3, F.lit(float("nan"))).otherwise(F.col("x")))
    return m.groupBy("voxel").agg(F.count_if(~A.finite(F.col("y"))).alias("n_bad"), F.count("*").alias("n"))


_CENTRES = [[(1.0 if (p % 4) == k else -0.25) for p in range(64)] for k in range(4)]
_DISTANCE = lambda c: f"list_sum(list_transform(range(1, 65), lambda p: (CAST(embedding[p] AS DOUBLE) - c{c}[p]) ** 2))"
_ASSIGN = "WITH c AS (SELECT " + ", ".join(f"{c} AS c{k}" for k, c in enumerate(_CENTRES)) + "), d AS (SELECT vec_id, embedding, " + ", ".join(f"{_DISTANCE(k)} AS d{k}" for k in range(4)) + " FROM embeddings, c), a AS (SELECT vec_id, embedding, CASE WHEN d0 <= least(d1, d2, d3) THEN 0 WHEN d1 <= least(d2, d3) THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster, least(d0, d1, d2, d3) AS distance FROM d)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


@query("kmeans_assign", f"{_ASSIGN} SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM a")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assign(points(spark, sf_dir), "embedding", _CENTRES).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("kmeans_round", f"{_ASSIGN} SELECT CAST(cluster AS INTEGER) AS cluster, CAST(p - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[p] AS DOUBLE)), 6) AS c FROM (SELECT cluster, embedding, unnest(range(1, 65)) AS p FROM a) GROUP BY 1, 2")
def kmeans_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.centres_of(C.assign(points(spark, sf_dir), "embedding", _CENTRES), "embedding").select("cluster", "pos", F.round("c", 6).alias("c"))


@query("co_activation")
def co_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of six patterns over all frames."""
    return C.co_activation(points(spark, sf_dir), "vec_id", "embedding", 6, rounds=20)[1]


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = L.pca(points(spark, sf_dir), "vec_id", "embedding", 10)
    return scores.withColumn("score", F.round("score", 6))
