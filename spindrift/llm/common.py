"""Helpers shared by the training-data operators: shared storage, size-checked broadcasts, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small side may be broadcast; a row here is a few hundred bytes at most.
BROADCAST_ROWS = 200_000
#: Keys at most that count as hot in a ``hub_join``; keys with fewer rows than the second number never do.
HUBS, HUB_ROWS = 50_000, 1_000
#: Short rows (a few numbers or hashes) for which a partition is worth its while, and partitions that are always left.
PART_ROWS, LEAST_PARTS = 50_000, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset, a local session gets a temporary folder; on a cluster that would be lost with an executor, so it raises.
    What is written there belongs to the session that set the folder, which removes it.
    """
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="spindrift-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffle join).

    Counting costs a job, so ``small`` should be cut (or a short scan) already.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most some ``rows`` short rows, in no more partitions than these need (never in more than it has).

    Each task of a stage leaves three files of a disk block at least for every shuffle that it writes, whatever it
    holds, and they stay until the driver collects its garbage: few rows in many partitions take disk by partitions.
    """
    return df.coalesce(max(LEAST_PARTS, -(-rows // PART_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a dataset folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxed(df: DataFrame, **named: str) -> DataFrame:
    """``_row``, all columns of ``df`` as one struct, and the named columns under new names.

    Whatever else ``df`` holds, no name of its own can then clash with one that an operator needs.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(n) for n, c in named.items()])


def unboxed(names: list[str], **changed: Column) -> list[Column]:
    """The columns ``names`` out of ``_row``, those in ``changed`` replaced."""
    return [changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in names]


def without(names: list[str], *gone: str) -> list[str]:
    return [c for c in names if c.lower() not in gone]


def runs(batches: Iterator, key: str) -> Iterator:
    """Consecutive rows with equal ``key`` from an iterator of pandas frames that arrive sorted by it.

    Only one group is held at a time.
    """
    import pandas as pd

    held, at = [], None
    for batch in batches:
        if not len(batch):
            continue
        change = batch[key].ne(batch[key].shift())
        for _, part in batch.groupby(change.cumsum(), sort=False):
            k = part[key].iloc[0]
            if held and k != at:
                yield at, pd.concat(held, ignore_index=True)
                held = []
            held.append(part)
            at = k
    if held:
        yield at, pd.concat(held, ignore_index=True)


def hub_join(rows: DataFrame, hubs: DataFrame, key: str, n: str, total: int, short: bool = False) -> DataFrame:
    """``rows`` with the columns of ``hubs`` (one row a key; ``n``: how many of ``rows`` have it), which lose ``n``.

    Keys that hold more than a ``HUBS``-th of ``total``, the number of ``rows``, are met by a broadcast of at
    most ``HUBS`` hubs where their rows lie, so that no task gets all rows of one key; the others shuffle.
    ``short`` rows are ``gathered`` after the shuffle.
    """
    few_parts = (lambda df: gathered(df, total)) if short else (lambda df: df)
    hot = F.col(n) > max(HUB_ROWS, total // HUBS)
    few = F.broadcast(few_parts(hubs.where(hot).drop(n)))
    there = rows.join(few, key)
    return there.unionByName(few_parts(rows.join(few.select(key), key, "left_anti").join(hubs.where(~hot).drop(n), key)))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node of its component.

    Alternates the two star contractions of Kiveris et al. (2014): in a large-star round each node hands
    its smallest neighbour to its larger neighbours, in a small-star round to the smaller ones. Every
    round is a grouped minimum (combined before the shuffle) and a join that broadcasts hot nodes; no
    adjacency list is ever collected. Partitions follow the number of edges. Null endpoints and self-loops are ignored; a node seen only in a
    self-loop is absent. Raises if it has not settled after ``max_rounds`` rounds.
    """

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        out = hub_join(both, low, "u", "n", total, short=True)
        if large:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                gathered(low.select(F.col("u").alias("a"), F.col("m").alias("b")), total)
            )
        return gathered(out.where("a <> b").distinct(), total)

    def stamp(e: DataFrame) -> tuple:
        h = F.xxhash64("a", "b")
        return tuple(e.agg(F.count("*"), F.sum(F.pmod(h, F.lit(1 << 31))), F.bit_xor(h)).first())

    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    e = cut(e.distinct())
    before = stamp(e)
    e = gathered(e, before[0])
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = cut(star(star(e, True, 2 * before[0]), False, before[0]))
        now = stamp(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = gathered(e.select("b").distinct(), before[0])
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
    )
