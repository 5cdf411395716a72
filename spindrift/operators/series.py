"""Series operators: every one keeps the runs apart, so windows partition by run and never by nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Groups up to which their moments are broadcast to the rows.
BROADCAST_GROUPS = 100_000


def _with_moments(df: DataFrame, moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the row of its group. A few groups are broadcast once counted, so rows stay where they lie and no task gets a group."""
    moments = cut(moments)
    few = moments.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return df.join(F.broadcast(moments) if few else moments, list(by))


def zscore(df: DataFrame, value: str, by: Sequence[str], out: str = "z", fill: float | None = 0.0) -> DataFrame:
    """Population z-score of ``value`` within ``by``. A constant (or NaN-holding) group becomes ``fill``.

    Two moments per group joined back: the sums combine before the shuffle.
    """
    x = F.col(value)
    m = df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = (x - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    z = F.when(F.isnan(z), None).otherwise(z)
    z = F.coalesce(z, F.lit(fill)) if fill is not None else z
    return _with_moments(df, m, by).withColumn(out, z).drop("_m", "_s")


def zscore_wide(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Each of ``columns`` z-scored within ``by``, in one pass over the groups."""
    stats = [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    m = df.groupBy(*by).agg(*stats)
    z = {c: (F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)) for c in columns}
    return _with_moments(df, m, by).withColumns(z).select(*df.columns)


def lag_matrix(df: DataFrame, value: str, lags: Sequence[int], by: Sequence[str], order: Sequence[str], fill: float | None = None) -> DataFrame:
    """One column ``lag_<k>`` (``lag_m<k>`` for negative k) per lag, ``fill`` past the edges.

    Lags longer than the series are all ``fill``. All share one window, hence one sort.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    names = {k: f"lag_{k}" if k >= 0 else f"lag_m{-k}" for k in lags}
    return df.withColumns({names[k]: (F.lag(value, k, fill) if k >= 0 else F.lead(value, -k, fill)).over(w) for k in lags})


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows where every one of ``columns`` is there (no lag reaches over an edge)."""
    return df.dropna("any", subset=list(columns))


def second_difference(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str = "d2") -> DataFrame:
    """x(t+2) - 2 x(t+1) + x(t); null on the last two rows of a run."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value))


def concat_runs(df: DataFrame, run: str, order: Sequence[str], out: str = "t_all") -> DataFrame:
    """A position over all runs, laid end to end by run name.

    Positions inside runs come from a window per run, the runs' starts from their lengths (one row a run),
    so no single task sees all rows.
    """
    sizes = df.groupBy(run).agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy(run).orderBy(*order)) - 1
    return df.join(starts.drop("_n"), run).withColumn(out, F.coalesce("_start", F.lit(0)) + inside).drop("_start")


def trim_head(df: DataFrame, n: int | Column, by: Sequence[str], order: Sequence[str], index: str = "ix") -> DataFrame:
    """Without the first ``n`` rows of each run, re-indexed from 0. A run of n rows or fewer vanishes."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("_at", at).where(F.col("_at") >= n).withColumn(index, F.col("_at") - n).drop("_at")


def dummy_samples(n_volumes: int, tr: float, rate: float) -> int:
    """Samples that ``n_volumes`` volumes of ``tr`` seconds take at ``rate`` Hz, cut to a whole number."""
    return int(n_volumes * tr * rate)


def trim_trigger(df: DataFrame, trigger: str, by: Sequence[str], index: str, level: int = 5) -> DataFrame:
    """Rows from the first to before the last one whose trigger, rounded half to even, is ``level``; a run without any is an error."""
    hit = F.bround(trigger) == level
    bounds = df.groupBy(*by).agg(F.min(F.when(hit, F.col(index))).alias("_lo"), F.max(F.when(hit, F.col(index))).alias("_hi"))
    ok = F.assert_true(F.col("_lo").isNotNull(), F.lit("a run has no trigger"))
    bounds = bounds.withColumn("_lo", F.when(ok.isNull(), F.col("_lo")))
    return df.join(bounds, list(by)).where((F.col(index) >= F.col("_lo")) & (F.col(index) < F.col("_hi"))).drop("_lo", "_hi")


def frame_range(df: DataFrame, t: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Frames start, start + step, ... before ``stop``."""
    if start < 0 or step <= 0 or (stop is not None and stop <= start):
        raise ValueError("need 0 <= start < stop and step > 0")
    c = F.col(t)
    keep = (c >= start) & ((c - start) % step == 0)
    return df.where(keep if stop is None else keep & (c < stop))


def peaks(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], threshold: Column | None = None, threshold_only: bool = False) -> DataFrame:
    """Strict local maxima at or above ``threshold``; ``threshold_only``: every sample at or above it."""
    x = F.col(value)
    high = x >= threshold if threshold is not None else F.lit(True)
    if threshold_only:
        return df.where(high)
    w = Window.partitionBy(*by).orderBy(*order)
    tagged = df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)})
    return tagged.where(high & (x > F.col("_a")) & (x > F.col("_b"))).drop("_a", "_b")


def top_peaks(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` highest rows of each run (earlier ones first among equals)."""
    w = Window.partitionBy(*by).orderBy(F.col(value).desc(), *order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def first_takes_second(df: DataFrame, value: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row's value of each run replaced by the second's (an edge artefact); single rows stay."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    return df.withColumn("_v", F.when(first, F.coalesce(F.lead(value).over(w), F.col(value))).otherwise(F.col(value))).withColumn(value, F.col("_v")).drop("_v")


def boxcar(grid: DataFrame, events: DataFrame, by: Sequence[str], t: str, onset: str, width: int, add: bool = True) -> DataFrame:
    """``grid`` with ``box``: how many events of ``width`` samples cover a sample.

    ``add`` sums impulses (+1 at the onset, -1 after the width) that fall on one sample; without it the
    sample is set instead, +1 first and the subtraction after, so coinciding onsets count once on entry.
    The last sample of the grid takes what falls beyond it.
    """
    by = list(by)
    last = grid.groupBy(*by).agg(F.max(t).alias("_last"))
    e = events.join(last, by).select(*by, F.least(F.col(onset), F.col("_last")).alias("_on"), F.least(F.col(onset) + width, F.col("_last")).alias("_off"))
    up = e.groupBy(*by, F.col("_on").alias(t)).agg(F.count("*").alias("_up"))
    down = e.groupBy(*by, F.col("_off").alias(t)).agg(F.count("*").alias("_down"))
    on = F.coalesce("_up", F.lit(0)) if add else F.when(F.col("_up") > 0, 1).otherwise(0)
    g = grid.join(up, [*by, t], "left").join(down, [*by, t], "left").withColumn("_d", on - F.coalesce("_down", F.lit(0)))
    w = Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("box", F.sum("_d").over(w)).drop("_up", "_down", "_d")
