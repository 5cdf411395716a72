"""Queries over series: z-scores, lags, trims, peaks, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basis as B
from ..operators import peaks as P
from ..operators import series as S
from . import inputs as I
from .inputs import HOUR_SQL, HOURLY_SQL, RUNS_SQL
from .registry import query

LAGS = (-2, -1, 0, 1, 3)
#: The inner knot of the lag basis; not a round one, so that no sum ends in a tie when rounded.
KNOTS = [2.7]


@query(
    "zscore_by_run",
    "SELECT event_id, round(coalesce((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 0), 6) AS z FROM events WINDOW w AS (PARTITION BY user_id)",
)
def zscore_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return S.zscore(e, "value", ["user_id"]).select("event_id", F.round("z", 6).alias("z"))


@query(
    "zscore_wide",
    "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 6) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)",
)
def zscore_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    df = I.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *cols)
    return S.zscore_wide(df, cols, ["l_returnflag"]).select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "lag_matrix",
    "SELECT event_id, " + ", ".join(f"{'lag' if k >= 0 else 'lead'}(value, {abs(k)}) OVER w AS {'lag_' if k >= 0 else 'lag_m'}{abs(k)}" for k in LAGS) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def lag_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.lag_matrix(e, "value", LAGS, ["user_id"], ["ts", "event_id"]).drop("user_id", "ts", "value")


@query(
    "lag_matrix_zero_fill",
    "SELECT event_id, " + ", ".join(f"{'lag' if k >= 0 else 'lead'}(value, {abs(k)}, 0.0) OVER w AS {'lag_' if k >= 0 else 'lag_m'}{abs(k)}" for k in LAGS) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def lag_matrix_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.lag_matrix(e, "value", LAGS, ["user_id"], ["ts", "event_id"], 0.0).drop("user_id", "ts", "value")


@query(
    "complete_rows",
    "SELECT event_id FROM (SELECT event_id, lag(value, 3) OVER w AS a, lead(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE a IS NOT NULL AND b IS NOT NULL",
)
def complete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.complete_rows(S.lag_matrix(e, "value", [-2, 3], ["user_id"], ["ts", "event_id"]), ["lag_m2", "lag_3"]).select("event_id")


@query(
    "second_difference",
    "SELECT event_id, round(lead(value, 2) OVER w - 2 * lead(value, 1) OVER w + value, 6) AS d2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def second_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return S.second_difference(e, "value", ["user_id"], ["ts", "event_id"]).select("event_id", F.round("d2", 6).alias("d2"))


@query("concat_runs", "SELECT vec_id, CAST(row_number() OVER (ORDER BY label, vec_id) - 1 AS BIGINT) AS t_all FROM embeddings")
def concat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = I.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return S.concat_runs(e, "label", ["vec_id"]).select("vec_id", "t_all")


@query(
    "dummy_trim",
    "SELECT event_id, CAST(k - 6 AS INTEGER) AS ix FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events) WHERE k >= 6",
)
def dummy_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of ten volumes of 1.5 s at 0.4 Hz dropped from each user's events."""
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return S.trim_head(e, S.dummy_samples(10, 1.5, 0.4), ["user_id"], ["ts", "event_id"]).select("event_id", "ix")


@query(
    "trigger_trim",
    """WITH b AS (SELECT user_id, min(event_id) FILTER (WHERE round_even(value / 100, 0) = 3) AS lo, max(event_id) FILTER (WHERE round_even(value / 100, 0) = 3) AS hi FROM events GROUP BY 1)
    SELECT e.event_id FROM events e JOIN b USING (user_id) WHERE e.event_id >= lo AND e.event_id < hi""",
)
def trigger_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the first and the last trigger (a value that rounds to 300) of each user who has one."""
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 100).alias("trigger"))
    some = e.where(F.bround("trigger") == 3).select("user_id").distinct()
    return S.trim_trigger(e.join(some, "user_id", "left_semi"), "trigger", ["user_id"], "event_id", 3).select("event_id")


@query("frame_range", "SELECT vec_id FROM embeddings WHERE vec_id >= 10 AND vec_id < 300 AND (vec_id - 10) % 7 = 0")
def frame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frame_range(I.table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 10, 300, 7)


@query("single_frame", f"SELECT voxel, x FROM {I.MATRIX_SQL} WHERE t = 42")
def single_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.matrix(spark, sf_dir).where("t = 42").select("voxel", "x")


@query(
    "peaks_threshold_topn",
    f"""WITH s AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM {RUNS_SQL} WINDOW w AS (PARTITION BY run ORDER BY t)),
    h AS (SELECT run, quantile_cont(x, 0.75) AS q FROM {RUNS_SQL} GROUP BY run),
    p AS (SELECT s.run, t, x, row_number() OVER (PARTITION BY s.run ORDER BY x DESC, t) AS k FROM s JOIN h ON s.run = h.run WHERE x >= q AND x > a AND x > b)
    SELECT run, t, round(x, 6) AS height FROM p WHERE k <= 20""",
)
def peaks_threshold_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = I.runs(spark, sf_dir)
    s = s.join(s.groupBy("run").agg(F.percentile("x", 0.75).alias("q")), "run")
    found = S.peaks(s, "x", ["run"], ["t"], F.col("q"))
    return S.top_peaks(found, "x", ["run"], ["t"], 20).select("run", "t", F.round("x", 6).alias("height"))


@query("peaks_threshold_only", f"WITH s AS {RUNS_SQL} SELECT run, t, round(x, 6) AS height FROM s WHERE x >= 260")
def peaks_threshold_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.peaks(I.runs(spark, sf_dir), "x", ["run"], ["t"], F.lit(260.0), threshold_only=True)
    return found.select("run", "t", F.round("x", 6).alias("height"))


_PEAKS_SQL = f"""
    WITH s AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY t) - 1 AS ix, x FROM {RUNS_SQL}),
    p AS (SELECT run, ix, x FROM (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s WINDOW w AS (PARTITION BY run ORDER BY ix)) WHERE x > a AND x > b),
    l AS (SELECT p.run, p.ix, coalesce(max(s.ix), 0) AS g FROM p LEFT JOIN s ON s.run = p.run AND s.ix < p.ix AND s.x > p.x GROUP BY 1, 2),
    r AS (SELECT p.run, p.ix, coalesce(min(s.ix), 1000000000) AS g FROM p LEFT JOIN s ON s.run = p.run AND s.ix > p.ix AND s.x > p.x GROUP BY 1, 2),
    b AS (
      SELECT p.run, p.ix, p.x, greatest(min(s.x) FILTER (WHERE s.ix <= p.ix), min(s.x) FILTER (WHERE s.ix >= p.ix)) AS low
      FROM p JOIN l ON l.run = p.run AND l.ix = p.ix JOIN r ON r.run = p.run AND r.ix = p.ix JOIN s ON s.run = p.run AND s.ix BETWEEN l.g AND r.g GROUP BY 1, 2, 3),
    h AS (SELECT run, ix, x, x - low AS prominence, greatest(x - (x - low) * 0.5, low) AS level FROM b WHERE x - low >= 20),
    e AS (
      SELECT h.run, h.ix, h.prominence, h.level, max(s.ix) FILTER (WHERE s.ix < h.ix) AS i, min(s.ix) FILTER (WHERE s.ix > h.ix) AS j
      FROM h JOIN s ON s.run = h.run AND s.x <= h.level GROUP BY 1, 2, 3, 4)
    SELECT e.run, CAST(e.ix AS BIGINT) AS ix, round(e.prominence, 6) AS prominence, round((e.j - (e.level - sj.x) / (sk.x - sj.x)) - (e.i + (e.level - si.x) / (sn.x - si.x)), 6) AS width
    FROM e JOIN s si ON si.run = e.run AND si.ix = e.i JOIN s sn ON sn.run = e.run AND sn.ix = e.i + 1 JOIN s sj ON sj.run = e.run AND sj.ix = e.j JOIN s sk ON sk.run = e.run AND sk.ix = e.j - 1"""


@query("peaks_prominence_width", _PEAKS_SQL)
def peaks_prominence_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each type's series that stand out by 20, with their width at half of it."""
    s = S.concat_runs(I.runs(spark, sf_dir), "run", ["t"], "n")
    s = s.join(s.groupBy("run").agg(F.min("n").alias("_n")), "run").withColumn("ix", F.col("n") - F.col("_n"))
    return P.find_peaks(s, "x", "run", "ix", prominence=20.0, chunk=256).select("run", "ix", F.round("prominence", 6).alias("prominence"), F.round("width", 6).alias("width"))


@query(
    "first_takes_second",
    f"SELECT run, t, round(CASE WHEN row_number() OVER w = 1 THEN coalesce(lead(x) OVER w, x) ELSE x END, 6) AS x FROM {RUNS_SQL} WINDOW w AS (PARTITION BY run ORDER BY t)",
)
def first_takes_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_takes_second(I.runs(spark, sf_dir), "x", ["run"], ["t"]).select("run", "t", F.round("x", 6).alias("x"))


@query(
    "spline_projection",
    f"""WITH s AS {HOURLY_SQL}, b(lag, k, w) AS (VALUES {", ".join(f"({lag}, {k}, CAST({float(w)!r} AS DOUBLE))" for lag, row in zip(range(6), B.natural_spline(range(6), 3, KNOTS)) for k, w in enumerate(row))}),
    n AS (SELECT t FROM s), j AS (SELECT s2.t + b.lag AS t, k, s2.x * w AS v FROM s s2, b)
    SELECT CAST(j.t AS BIGINT) AS t, CAST(k AS INTEGER) AS k, round(sum(v), 4) AS v FROM j JOIN n ON n.t = j.t GROUP BY 1, 2 HAVING count(*) = 6""",
)
def spline_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly series' lags 0 to 5 on a natural spline of three columns; hours with a missing lag go."""
    basis = B.basis_table(spark, range(6), 3, knots=KNOTS)
    out = B.project(I.hourly(spark, sf_dir).withColumn("run", F.lit(0)), basis, ["run"], "t", "x", 6)
    return out.select("t", "k", F.round("v", 4).alias("v"))
