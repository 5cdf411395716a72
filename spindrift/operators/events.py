"""Event operators: trial grouping and event-locked averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_trial(events: DataFrame, trial: str) -> DataFrame:
    return events.where(F.col("trial_type") == trial)


def trial_types(events: DataFrame) -> DataFrame:
    """Distinct trial types in a fixed order."""
    return events.select("trial_type").distinct().orderBy("trial_type")


def max_duration(events: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """The longest duration of each trial type over all runs; 0 for a type of ``trials`` that never occurs."""
    got = events.groupBy("trial_type").agg(F.max("duration").alias("max_duration"))
    if trials is None:
        return got
    return trials.join(got, "trial_type", "left").withColumn("max_duration", F.coalesce("max_duration", F.lit(0.0)))


def group_trials(events: DataFrame, by: Sequence[str], order: Sequence[str], cue: Column) -> DataFrame:
    """Rows from one cue to before the next as one trial: first onset and type, summed duration, row count.

    Rows before the first cue form trial 0 of their run.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = events.withColumn("trial", F.sum(F.when(cue, 1).otherwise(0)).over(w))
    at = F.struct(*order)
    return tagged.groupBy(*by, "trial").agg(F.min_by("onset", at).alias("onset"), F.sum("duration").alias("duration"), F.min_by("trial_type", at).alias("trial_type"), F.count("*").alias("n_rows"))


def onset_index(onset: Column, tr: float) -> Column:
    """Seconds to a sample, cut towards zero (an onset just before 0 is sample 0)."""
    return (onset / tr).cast("int")


def segments(series: DataFrame, events: DataFrame, by: Sequence[str], t: str, value: str, onset: str, length: int, n: Column | None = None) -> DataFrame:
    """``(by, trial_type, lag, value)`` for each event whose whole segment lies inside its run.

    Instead of a range join, each event names the ``length`` samples that it needs and is joined by run and
    sample: a plain equi-join that any number of executors can share. ``n``: a run's length, if not its
    last sample + 1.
    """
    by = list(by)
    if n is None:
        ends = series.groupBy(*by).agg((F.max(t) + 1).alias("_n")) if by else series.agg((F.max(t) + 1).alias("_n"))
        events = events.join(ends, by) if by else events.crossJoin(F.broadcast(ends))
    else:
        events = events.withColumn("_n", n)
    inside = events.where((F.col(onset) >= 0) & (F.col(onset) + length <= F.col("_n")))
    wanted = inside.select(*by, "trial_type", F.col(onset).alias("_on"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("lag"))
    wanted = wanted.withColumn(t, F.col("_on") + F.col("lag"))
    return wanted.join(series.select(*by, t, value), [*by, t]).select(*by, "trial_type", "lag", value)


def event_average(series: DataFrame, events: DataFrame, by: Sequence[str], t: str, value: str, onset: str, length: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean response by trial type and lag over all events of all runs, with the number of samples averaged.

    Events are first counted by (run, sample, type), since events with one onset see one segment; the
    weighted sums then equal the plain mean.
    """
    by = list(by)
    counted = events.groupBy(*by, "trial_type", onset).agg(F.count("*").alias("_c"))
    ends = series.groupBy(*by).agg((F.max(t) + 1).alias("_n")) if by else series.agg((F.max(t) + 1).alias("_n"))
    counted = counted.join(ends, by) if by else counted.crossJoin(F.broadcast(ends))
    inside = counted.where((F.col(onset) >= 0) & (F.col(onset) + length <= F.col("_n")))
    wanted = inside.select(*by, "trial_type", "_c", F.col(onset).alias("_on"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("lag"))
    met = wanted.withColumn(t, F.col("_on") + F.col("lag")).join(series.select(*by, t, value, *keys), [*by, t])
    return met.groupBy("trial_type", "lag", *keys).agg((F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("avg_response"), F.sum("_c").alias("n_events"))


def event_average_window(series: DataFrame, events: DataFrame, by: Sequence[str], t: str, value: str, tr: float, window: tuple[float, float] | None = None, extend: int = 0) -> DataFrame:
    """``trial_type, lag, avg_response, n_events`` of events with ``onset, duration`` in seconds (or the series' unit).

    With ``window`` a segment runs between those two offsets from the onset, else from the onset for each
    event's own duration and ``extend`` samples more. Onset, offset and length are each cut to whole samples.
    Segments that don't lie inside their run are left out. Segments of unequal length are averaged at each
    lag over those that reach it. Events with one start and length are counted first; the join is by sample.
    """
    by = list(by)
    samples = lambda c: (c / tr).cast("int")
    first = samples(F.col("onset"))
    length = samples(F.col("duration")) + extend
    if window is not None:
        first, length = first + int(window[0] / tr), F.lit(int((window[1] - window[0]) / tr))
    counted = events.select(*by, "trial_type", first.alias("_on"), length.alias("_len")).groupBy(*by, "trial_type", "_on", "_len").agg(F.count("*").alias("_c"))
    ends = series.groupBy(*by).agg((F.max(t) + 1).alias("_n")) if by else series.agg((F.max(t) + 1).alias("_n"))
    counted = counted.join(ends, by) if by else counted.crossJoin(F.broadcast(ends))
    inside = counted.where((F.col("_on") >= 0) & (F.col("_on") < F.col("_n")) & (F.col("_on") + F.col("_len") <= F.col("_n")) & (F.col("_len") > 0))
    wanted = inside.select(*by, "trial_type", "_c", F.explode(F.sequence(F.lit(0), F.col("_len") - 1)).alias("lag"), "_on").withColumn(t, F.col("_on") + F.col("lag"))
    met = wanted.join(series.select(*by, t, value), [*by, t])
    return met.groupBy("trial_type", "lag").agg((F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("avg_response"), F.sum("_c").alias("n_events"))


def kept_events(events: DataFrame, onset: str, length: int, n: int) -> DataFrame:
    """``trial_type, onset, n_events``: the onsets whose segment fits, each with how many events share it."""
    inside = events.where((F.col(onset) >= 0) & (F.col(onset) + length <= n))
    return inside.groupBy("trial_type", F.col(onset).alias("onset")).agg(F.count("*").alias("n_events"))
