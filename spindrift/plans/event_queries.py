"""Queries over events: averages, grouping, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import series as S
from . import inputs as I
from .inputs import HOUR_SQL, HOURLY_SQL, RUNS_SQL, SECONDS_SQL
from .registry import query

LENGTH = 6


@query(
    "event_average",
    f"""WITH s AS {HOURLY_SQL}, n AS (SELECT max(t) + 1 AS n FROM s), e AS (SELECT event_type, {HOUR_SQL} AS on_ix FROM events),
    k AS (SELECT e.* FROM e, n WHERE on_ix + {LENGTH} <= n)
    SELECT event_type, CAST(s.t - k.on_ix AS INTEGER) AS lag, round(avg(s.x), 6) AS avg_response, count(*) AS n_events
    FROM k JOIN s ON s.t >= k.on_ix AND s.t < k.on_ix + {LENGTH} GROUP BY 1, 2""",
)
def event_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hourly value in the six hours from each event on, by event type."""
    out = E.event_average(I.hourly(spark, sf_dir), I.events(spark, sf_dir), [], "t", "x", "t", LENGTH)
    return out.select(F.col("trial_type").alias("event_type"), "lag", F.round("avg_response", 6).alias("avg_response"), "n_events")


@query(
    "event_average_by_run",
    f"""WITH s AS {RUNS_SQL}, n AS (SELECT run, max(t) + 1 AS n FROM s GROUP BY run), e AS (SELECT event_type AS run, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS trial_type, {HOUR_SQL} AS on_ix FROM events),
    k AS (SELECT e.* FROM e JOIN n USING (run) WHERE on_ix + {LENGTH} <= n)
    SELECT trial_type, CAST(s.t - k.on_ix AS INTEGER) AS lag, round(avg(s.x), 6) AS avg_response, count(*) AS n_events
    FROM k JOIN s ON s.run = k.run AND s.t >= k.on_ix AND s.t < k.on_ix + {LENGTH} GROUP BY 1, 2""",
)
def event_average_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut from the event's own run, averaged over runs."""
    e = I.events(spark, sf_dir).select(F.col("event_type").alias("run"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("trial_type"), "t")
    out = E.event_average(I.runs(spark, sf_dir), e, ["run"], "t", "x", "t", LENGTH)
    return out.select("trial_type", "lag", F.round("avg_response", 6).alias("avg_response"), "n_events")


def _window_sql(first: str, length: str) -> str:
    return f"""WITH s AS {HOURLY_SQL}, n AS (SELECT max(t) + 1 AS n FROM s),
    e AS (SELECT event_type AS trial_type, {first} AS on_ix, {length} AS len FROM events),
    k AS (SELECT e.* FROM e, n WHERE on_ix >= 0 AND on_ix < n AND on_ix + len <= n AND len > 0)
    SELECT trial_type, CAST(s.t - k.on_ix AS INTEGER) AS lag, round(avg(s.x), 6) AS avg_response, count(*) AS n_events
    FROM k JOIN s ON s.t >= k.on_ix AND s.t < k.on_ix + k.len GROUP BY 1, 2"""


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.events(spark, sf_dir).select("trial_type", F.col("t").cast("double").alias("onset"), (F.col("user_id") % 5).cast("double").alias("duration"))


@query("event_average_bounds", _window_sql(f"{HOUR_SQL} - 2", "6"))
def event_average_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hourly value from two hours before to four after each event."""
    out = E.event_average_window(I.hourly(spark, sf_dir), _hours(spark, sf_dir), [], "t", "x", 1.0, (-2.0, 4.0))
    return out.select("trial_type", "lag", F.round("avg_response", 6).alias("avg_response"), "n_events")


@query("event_average_durations", _window_sql(HOUR_SQL, "user_id % 5 + 1"))
def event_average_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean hourly value over each event's own duration and an hour more."""
    out = E.event_average_window(I.hourly(spark, sf_dir), _hours(spark, sf_dir), [], "t", "x", 1.0, extend=1)
    return out.select("trial_type", "lag", F.round("avg_response", 6).alias("avg_response"), "n_events")


@query(
    "kept_events",
    f"""SELECT event_type AS trial_type, count(*) AS n_kept, min({HOUR_SQL}) AS first_onset, max({HOUR_SQL}) AS last_onset, CAST(sum({HOUR_SQL}) AS BIGINT) AS sum_onset
    FROM events WHERE {HOUR_SQL} + {LENGTH} <= (SELECT max({HOUR_SQL}) + 1 FROM events) GROUP BY 1""",
)
def kept_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type whose six hours lie inside the series."""
    e = I.events(spark, sf_dir)
    out = E.kept_events(e, "t", LENGTH, (e.agg(F.max("t")).first()[0] or 0) + 1)
    return out.groupBy("trial_type").agg(F.sum("n_events").alias("n_kept"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"), F.sum(F.col("onset") * F.col("n_events")).alias("sum_onset"))


@query("keep_trial", f"SELECT event_id, {SECONDS_SQL} AS onset, value FROM events WHERE event_type = 'click'")
def keep_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.keep_trial(I.events(spark, sf_dir), "click").select("event_id", F.col("sec").alias("onset"), "value")


@query("trial_types", "SELECT DISTINCT event_type AS trial_type FROM events ORDER BY 1")
def trial_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trial_types(I.events(spark, sf_dir))


@query(
    "max_duration",
    "SELECT t.trial_type, coalesce(max(e.value), 0.0) AS max_duration FROM (VALUES ('click'), ('view'), ('absent')) t(trial_type) LEFT JOIN events e ON e.event_type = t.trial_type GROUP BY 1",
)
def max_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    trials = spark.createDataFrame([("click",), ("view",), ("absent",)], "trial_type string")
    return E.max_duration(I.events(spark, sf_dir).withColumn("duration", F.col("value")), trials)


@query(
    "trial_grouping",
    f"""WITH c AS (SELECT *, {SECONDS_SQL} AS sec, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS trial FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, trial ORDER BY ts, event_id) AS k FROM c)
    SELECT user_id, CAST(trial AS BIGINT) AS trial, max(CASE WHEN k = 1 THEN sec END) AS onset, round(sum(value), 4) AS duration, max(CASE WHEN k = 1 THEN event_type END) AS trial_type, count(*) AS n_rows
    FROM f GROUP BY user_id, trial""",
)
def trial_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from one signup to the next are one trial."""
    e = I.events(spark, sf_dir).withColumns({"onset": F.col("sec"), "duration": F.col("value")})
    out = E.group_trials(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return out.withColumn("duration", F.round("duration", 4))


@query(
    "boxcar",
    f"""WITH n AS (SELECT max({HOUR_SQL}) AS last FROM events), g AS (SELECT run, unnest(range(0, last + 1)) AS t FROM (SELECT DISTINCT event_type AS run FROM events), n),
    e AS (SELECT event_type AS run, {HOUR_SQL} AS on_ix, last FROM events, n),
    i AS (SELECT run, least(on_ix, last) AS t, 1 AS d FROM e UNION ALL SELECT run, least(on_ix + 3, last), -1 FROM e),
    s AS (SELECT run, t, sum(d) AS d FROM i GROUP BY 1, 2)
    SELECT g.run, CAST(g.t AS BIGINT) AS t, CAST(sum(coalesce(d, 0)) OVER (PARTITION BY g.run ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS box FROM g LEFT JOIN s ON s.run = g.run AND s.t = g.t""",
)
def boxcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many three-hour boxes of events cover each hour of a run; all runs end with the last event's hour."""
    e = I.events(spark, sf_dir).select(F.col("event_type").alias("run"), F.col("t").alias("onset"))
    grid = e.select("run").distinct().crossJoin(e.agg(F.max("onset").alias("last"))).select("run", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("t"))
    return S.boxcar(grid, e, ["run"], "t", "onset", 3).select("run", "t", F.col("box").cast("long").alias("box"))


@query(
    "json_sidecar",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events",
)
def json_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import json_field

    return I.table(spark, sf_dir, "events").select("event_id", json_field(F.col("props"), "k").alias("k"))
