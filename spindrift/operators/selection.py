"""Exact order statistics and percentiles of groups of any size, without a group in one task.

A group of few values is left to Spark's exact aggregate. In a larger one each wanted rank has a bracket of values
that surely holds it: a sketch of the bracket proposes a narrower one, a count of what lies left of it and in it
says where the rank is, and so on until the bracket holds few values, which are then counted by value and summed up
in order. A pass is a grouped aggregation that is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Values that one task may hold; places of a sketch, and its ranks per place.
FEW, PLACES, FINE = 100_000, 1000, 16
BROADCAST_ROWS = 100_000


def _small(table: DataFrame) -> DataFrame:
    """With a broadcast hint if it has few rows (a handful of numbers each)."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _narrowed(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    """``brackets(_k, rank, lo, hi, below, inside)``, each a few hundred times narrower."""
    distinct = _small(cut(brackets.select("_k", "lo", "hi").distinct()))
    at = [k / PLACES for k in range(PLACES + 1)]
    sketch = rows.join(distinct, "_k").where("x BETWEEN lo AND hi").groupBy("_k", "lo", "hi").agg(F.percentile_approx("x", at, PLACES * FINE).alias("_s"))
    share = (F.col("rank") - F.col("below")) / F.greatest(F.col("inside") - 1, F.lit(1)) * PLACES
    a = F.get("_s", F.greatest(F.floor(share) - 1, F.lit(0)).cast("int"))
    b = F.get("_s", F.least(F.ceil(share) + 1, F.lit(PLACES)).cast("int"))
    proposed = _small(cut(brackets.join(sketch, ["_k", "lo", "hi"]).withColumns({"a": a, "b": b}).drop("_s")))
    left, mid, x = F.col("x") < F.col("a"), F.col("x").between(F.col("a"), F.col("b")), F.col("x")
    counts = (
        rows.join(proposed, "_k").where("x BETWEEN lo AND hi").groupBy(*proposed.columns)
        .agg(F.count_if(left).alias("n_left"), F.count_if(mid).alias("n_mid"), F.max(F.when(left, x)).alias("last"), F.min(F.when(~left & ~mid, x)).alias("first"))
    )
    place = F.col("rank") - F.col("below")
    in_left, in_mid = place < F.col("n_left"), place < F.col("n_left") + F.col("n_mid")
    pick = lambda l, m, r: F.when(in_left, l).when(in_mid, m).otherwise(r)
    c = F.col
    return counts.select(
        "_k", "rank", pick(c("lo"), c("a"), c("first")).alias("lo"), pick(c("last"), c("b"), c("hi")).alias("hi"),
        pick(c("below"), c("below") + c("n_left"), c("below") + c("n_left") + c("n_mid")).alias("below"),
        pick(c("n_left"), c("n_mid"), c("inside") - c("n_left") - c("n_mid")).alias("inside"),
    )


def order_statistics(rows: DataFrame, wanted: DataFrame, few: int = FEW, max_rounds: int = 64) -> DataFrame:
    """``_k, rank, x`` for each row of ``wanted(_k, rank, lo, hi, inside)``: the value of that rank, from 0, among ``rows(_k, x)`` of the key.

    ``lo``, ``hi`` and ``inside`` are the least and largest value of a key and their number. ``rows`` is read twice
    a round, and each round leaves about three thousandths of a bracket; equal values end it at once.
    """
    open_, ready = cut(wanted.withColumn("below", F.lit(0).cast("long"))), []
    for _ in range(max_rounds):
        closed = (F.col("inside") <= few) | (F.col("lo") == F.col("hi"))
        ready.append(open_.where(closed))
        open_ = open_.where(~closed)
        if open_.isEmpty():
            break
        open_ = cut(_narrowed(rows, open_))
    else:
        raise RuntimeError(f"ranks are not found after {max_rounds} rounds")
    found = ready[0]
    for r in ready[1:]:
        found = found.unionByName(r)
    found = cut(found)
    several = found.where("lo < hi")
    distinct = _small(cut(several.select("_k", "lo", "hi").distinct()))
    counted = rows.join(distinct, "_k").where("x BETWEEN lo AND hi").groupBy("_k", "lo", "hi", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("_k", "lo", "hi").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = counted.withColumn("upto", F.sum("n").over(upto)).join(_small(several), ["_k", "lo", "hi"]).where("upto > rank - below")
    return found.where("lo = hi").select("_k", "rank", F.col("lo").alias("x")).unionByName(running.groupBy("_k", "rank").agg(F.min("x").alias("x")))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], at: Sequence[float], few: int = FEW) -> DataFrame:
    """``by`` and ``q``, an array of the quantiles ``at`` (0 to 1), interpolated between the two nearest values.

    Null and NaN are left out; a group without other values has no row. Null is a group like any other; without
    ``by`` all rows are one. Groups of more than ``few`` values go through ``order_statistics``, which reads ``df``
    several times: write it first if it is dear to compute.
    """
    at = [float(p) for p in at]
    if not at or not all(0 <= p <= 1 for p in at):
        raise ValueError("quantiles must be from 0 to 1")
    key = F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("_"))
    x = F.col(f"`{value}`").cast("double")
    rows = df.select(key.alias("_k"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    sizes = cut(rows.groupBy("_k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("inside")))
    small, large = sizes.where(F.col("inside") <= few), cut(sizes.where(F.col("inside") > few))
    named = lambda d: d.select(*[F.col(f"_k.k{i}").alias(c) for i, c in enumerate(by)], "q")
    exact = F.percentile("x", F.array(*map(F.lit, at))).alias("q")
    if large.isEmpty():
        return named(rows.groupBy("_k").agg(exact))
    places = large.withColumn("_p", F.array(*[(F.col("inside") - 1) * F.lit(p) for p in at]))
    ranks = F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(F.floor(p), F.ceil(p)))))
    wanted = places.select("_k", "lo", "hi", "inside", F.explode(ranks).alias("rank"))
    values = order_statistics(rows.join(_small(large.select("_k")), "_k", "left_semi"), wanted, few)
    maps = values.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("_x"))  # two ranks a quantile

    def between(p):
        low, high = F.col("_x")[F.floor(p)], F.col("_x")[F.ceil(p)]
        return low + (high - low) * (p - F.floor(p))

    of_large = places.join(maps, "_k").select("_k", F.transform("_p", between).alias("q"))
    of_small = rows.join(_small(cut(small.select("_k"))), "_k", "left_semi").groupBy("_k").agg(exact)
    return named(of_large.unionByName(of_small))
