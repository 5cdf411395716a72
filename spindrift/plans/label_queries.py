"""Queries over labels: box statistics, bounds, masks, legends, fit measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as B
from ..operators import spatial as G
from ..operators import stats as A
from ..sources import sinks as K
from . import inputs as I
from .inputs import MATRIX_SQL
from .registry import query


@query(
    "label_box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, avg(value) AS mean FROM events GROUP BY 1)
    SELECT q.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean,
      min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS high
    FROM events e JOIN q ON e.event_type = q.event_type GROUP BY ALL""",
)
def label_box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.box_stats(I.table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "mean")], "low", "high")


@query("intensity_bounds", f"SELECT label, round(quantile_cont(x, 0.01), 6) AS vmin, round(quantile_cont(x, 0.99), 6) AS vmax FROM {MATRIX_SQL} GROUP BY label")
def intensity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.intensity_bounds(I.matrix(spark, sf_dir), "x", 1, 99, ["label"]).select("label", F.round("vmin", 6).alias("vmin"), F.round("vmax", 6).alias("vmax"))


@query("percentiles", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.quantiles(I.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], (0.05, 0.5, 0.95))
    return p.select("l_returnflag", *[F.round(F.get("q", F.lit(k)), 4).alias(n) for k, n in enumerate(("p05", "p50", "p95"))])


@query(
    "second_diff_rms",
    """WITH d AS (SELECT user_id, lead(value, 2) OVER w - 2 * lead(value, 1) OVER w + value AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(coalesce(sqrt(avg(d * d)), 0), 6) AS rms FROM d GROUP BY 1""",
)
def second_diff_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.difference_rms(I.table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"]).select("user_id", F.round("rms", 6).alias("rms"))


@query("nrmse", "SELECT user_id, round(sqrt(avg((value - f) ** 2)) / nullif(median(abs(value)), 0), 6) AS nrmse FROM (SELECT user_id, value, avg(value) OVER (PARTITION BY event_type) AS f FROM events) GROUP BY 1")
def nrmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the type's mean fits each user's values."""
    e = I.table(spark, sf_dir, "events")
    fitted = e.join(e.groupBy("event_type").agg(F.avg("value").alias("f")), "event_type")
    return A.normalised_rmse(fitted, "value", "f", ["user_id"]).select("user_id", F.round("nrmse", 6).alias("nrmse"))


@query(
    "fit_summary",
    """WITH f AS (SELECT event_type, CASE WHEN user_id % 7 = 0 THEN NULL ELSE least(value, 400) END AS x FROM events)
    SELECT event_type, round(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END), 6) AS nan_fraction, round(avg(CASE WHEN abs(x - 400) <= 0.004 THEN 1.0 WHEN x IS NOT NULL THEN 0.0 END), 6) AS clip_fraction,
      round(median(x), 6) AS median, round(quantile_cont(x, 0.99), 6) AS p99 FROM f GROUP BY 1""",
)
def fit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").withColumn("x", F.when(F.col("user_id") % 7 != 0, F.least("value", F.lit(400.0))))
    out = A.fit_summary(e, "x", 400.0, ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("nan_fraction", "clip_fraction", "median", "p99")])


@query("value_counts", "SELECT l_linenumber AS n_good, count(*) AS n FROM lineitem GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("n_good")).agg(F.count("*").alias("n"))


@query("eligible_voxels", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) >= 3")
def eligible_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n_good")).where("n_good >= 3").select("l_orderkey")


@query("label_keys", "SELECT DISTINCT p_size AS key FROM part WHERE lower(p_type) LIKE '%a%' AND (contains(lower(p_brand), '1') OR contains(lower(p_brand), '3')) ORDER BY 1")
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = I.table(spark, sf_dir, "part").where(F.contains(F.lower("p_type"), F.lit("a"))).select(F.col("p_size").alias("key"), F.col("p_brand").alias("name"))
    return B.find_keys(names, ["1", "3"], "contains", ignore_case=True)


@query("roi_mask", "SELECT vec_id AS vertex, coalesce(label IN (2, 5, 7), false) AS in_roi FROM embeddings")
def roi_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vertex"), F.col("label").cast("double").alias("label"))
    return B.roi_mask(v, spark.createDataFrame([(2,), (5,), (7,)], "key int"))


@query("label_discretise", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS index FROM orders")
def label_discretise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.discretise(I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", F.col("index").cast("int").alias("index"))


@query("label_indices", "SELECT label, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM embeddings WHERE label <> 0 GROUP BY 1")
def label_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.index_lists(I.table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return out.select("label", F.size("indices").cast("long").alias("n"), F.get("indices", F.lit(0)).alias("first"), F.element_at("indices", -1).alias("last"))


@query("vertex_scatter", "SELECT r.vertex, coalesce(e.label, -1) AS label FROM (SELECT unnest(range(0, last + 101)) AS vertex FROM (SELECT max(vec_id) AS last FROM embeddings)) r LEFT JOIN embeddings e ON e.vec_id = r.vertex")
def vertex_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels on a grid that ends a hundred vertices after the last one with a label."""
    full = spark.range(I.length(spark, sf_dir) + 100).withColumnRenamed("id", "vertex")
    return B.scatter(full, I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vertex"), "label")).withColumn("label", F.coalesce("label", F.lit(-1)))


@query("label_legend", "SELECT c_custkey, n_name AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey")
def label_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the name of their nation, where the legend has it."""
    names = I.table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    values = I.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    return B.legend(values, names).select("c_custkey", "name")


@query(
    "label_table",
    """SELECT key, CASE WHEN key = 0 THEN 'unlabelled' ELSE 'label-' || CAST(key AS VARCHAR) END AS name,
      CASE WHEN key <= 0 THEN 0.0 ELSE round((key * 37 % 255) / 255.0, 6) END AS r, CASE WHEN key <= 0 THEN 0.0 ELSE round((key * 91 % 255) / 255.0, 6) END AS g,
      CASE WHEN key <= 0 THEN 0.0 ELSE round((key * 173 % 255) / 255.0, 6) END AS b FROM (SELECT DISTINCT label AS key FROM embeddings UNION SELECT 0)""",
)
def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = K.label_table(I.table(spark, sf_dir, "embeddings").select(F.col("label").alias("key")).distinct())
    return t.select("key", "name", *[F.round(F.get("rgba", F.lit(k)), 6).alias(c) for k, c in enumerate("rgb")])


@query("bounding_box", f"SELECT round(min(x) - 0.1 * (max(x) - min(x)), 6) AS min_x, round(max(x) + 0.1 * (max(x) - min(x)), 6) AS max_x, round(min(t) - 0.1 * (max(t) - min(t)), 6) AS min_t, round(max(t) + 0.1 * (max(t) - min(t)), 6) AS max_t FROM {MATRIX_SQL} WHERE label = 3")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = A.bounding_box(I.matrix(spark, sf_dir).where("label = 3").withColumn("t", F.col("t").cast("double")), ["x", "t"], 0.1)
    return box.select(*[F.round(c, 6).alias(c) for c in box.columns])


@query(
    "face_levels",
    f"""WITH f AS (SELECT vec_id AS face, unnest([vec_id % 64, (vec_id * 7) % 64, (vec_id * 13) % 64]) AS voxel FROM embeddings), v AS (SELECT voxel, avg(x) AS x FROM {MATRIX_SQL} GROUP BY 1),
    a AS (SELECT face, avg(v.x) AS x FROM f JOIN v USING (voxel) GROUP BY 1) SELECT face, round(greatest(0.0, least(1.0, (x + 0.02) / 0.04)), 6) AS level FROM a""",
)
def face_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of three vertices each, on a scale from -0.02 to 0.02."""
    v = F.col("vec_id")
    faces = I.table(spark, sf_dir, "embeddings").select(v.alias("face"), F.array((v % 64).cast("int"), ((v * 7) % 64).cast("int"), ((v * 13) % 64).cast("int")).alias("vertices"))
    values = A.column_moments(I.matrix(spark, sf_dir)).select(F.col("voxel").alias("vertex"), F.col("mean").alias("x"))
    got = A.face_levels(A.face_values(faces, values), F.lit(-0.02), F.lit(0.02))
    return got.select("face", F.round("level", 6).alias("level"))


@query("unmask_grid", f"WITH g AS (SELECT t, voxel FROM (SELECT unnest(range(0, last + 1)) AS t FROM (SELECT max(vec_id) AS last FROM embeddings)), range(0, 80) b(voxel)) SELECT g.t, CAST(g.voxel AS INTEGER) AS voxel, coalesce(m.x, 0.0) AS x FROM g LEFT JOIN {MATRIX_SQL} m ON m.t = g.t AND m.voxel = g.voxel")
def unmask_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames on a grid of 80 voxels, of which the matrix has 64."""
    grid = spark.range(I.length(spark, sf_dir)).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(79))).alias("voxel"))
    return K.to_grid(I.matrix(spark, sf_dir).select("t", "voxel", "x"), grid, ["t", "voxel"])


_VOLUME = f"(SELECT CAST(t % 10 AS INTEGER) AS i, CAST(t // 10 AS INTEGER) AS j, voxel AS k, x AS v FROM {MATRIX_SQL})"


@query("sample_nearest", f"WITH p AS (SELECT event_id AS id, (event_id % 90) / 10.0 AS x, (event_id % 1801) / 9.0 AS y, (event_id % 61) + 0.25 AS z FROM events) SELECT id, round(v, 6) AS value FROM p LEFT JOIN {_VOLUME} m ON m.i = round_even(p.x, 0) AND m.j = round_even(p.y, 0) AND m.k = round_even(p.z, 0)")
def sample_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nearest(sample_points(spark, sf_dir), volume(spark, sf_dir)).select("id", F.round("value", 6).alias("value"))


@query(
    "sample_linear",
    f"""WITH p AS (SELECT event_id AS id, (event_id % 90) / 10.0 AS x, (event_id % 1801) / 9.0 AS y, (event_id % 61) + 0.25 AS z FROM events),
    c AS (
      SELECT id, CAST(floor(x) AS BIGINT) + a AS i, CAST(floor(y) AS BIGINT) + b AS j, CAST(floor(z) AS BIGINT) + c AS k,
        (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS w
      FROM p, range(0, 2) r(a), range(0, 2) s(b), range(0, 2) t(c))
    SELECT id, round(CASE WHEN count(*) = count(v) THEN sum(w * v) END, 6) AS value FROM c LEFT JOIN {_VOLUME} m ON m.i = c.i AND m.j = c.j AND m.k = c.k WHERE w > 0 GROUP BY id""",
)
def sample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.linear(sample_points(spark, sf_dir), volume(spark, sf_dir)).select("id", F.round("value", 6).alias("value"))


@query("sample_cubic")
def sample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole part of the volume, which may end within a row of ten, by a cubic spline."""
    v = volume(spark, sf_dir)
    rows = v.groupBy("j").agg(F.count_distinct("i").alias("n"))
    whole = v.join(rows.where("n < 10").agg(F.coalesce(F.min("j"), F.lit(1 << 30)).alias("_j")), F.col("j") < F.col("_j")).drop("_j")
    return G.sample(sample_points(spark, sf_dir), whole, "cubic").select("id", F.round("value", 6).alias("value"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix as one volume: ten frames wide, as long as it takes, as deep as a vector."""
    m = I.matrix(spark, sf_dir)
    return m.select((F.col("t") % 10).cast("int").alias("i"), F.floor(F.col("t") / 10).cast("int").alias("j"), F.col("voxel").alias("k"), F.col("x").alias("v"))


def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return I.table(spark, sf_dir, "events").select(e.alias("id"), ((e % 90) / 10.0).alias("x"), ((e % 1801) / 9.0).alias("y"), ((e % 61) + 0.25).alias("z"))


@query("depth_mean", f"SELECT voxel AS vertex, t // 3 AS t, round(avg(x), 6) AS x FROM {MATRIX_SQL} GROUP BY 1, 2")
def depth_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = I.matrix(spark, sf_dir).select(F.col("voxel").alias("vertex"), F.floor(F.col("t") / 3).alias("t"), "x")
    return G.depth_mean(m).select("vertex", "t", F.round("x", 6).alias("x"))


@query("sample_voxels")
def sample_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed pseudo-random sample of 200 eligible orders."""
    from ..operators.decay import sample_voxels as pick

    v = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("voxel_id")).agg(F.max("l_linenumber").alias("n_good"))
    return pick(v, 200)
