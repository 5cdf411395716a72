"""Peaks of series of any length: height, plateau, distance, prominence and width, with a chunk of a series in a task.

A series is dealt out in chunks. A table of a few numbers a chunk (its extremes and ends) tells each task what lies
beyond its own chunk: a flat top that goes on, or the nearest chunk that rises above a peak or falls below a level.
Only what needs a sample of that other chunk is sent there as a question, and each chunk answers all of its own at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Samples of a chunk, and chunks that the table may have (some 80 bytes each).
CHUNK, MOST_CHUNKS = 1 << 16, 2_000_000

Limits = float | tuple[float | None, float | None] | None


def _within(column: str, limits: Limits) -> F.Column:
    low, high = limits if isinstance(limits, tuple) else (limits, None)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(column) >= low)
    return ok if high is None else ok & (F.col(column) <= high)


class Table:
    """Per series its chunks' sizes, extremes, ends, the length of the flat start and the value after it."""

    def __init__(self, chunks: DataFrame):
        def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for run, c, first, raw in zip(batch["_run"], batch["_chunk"], batch["_first"], batch["_x"]):
                    x = np.asarray(raw, float)
                    change = np.flatnonzero(x != x[0])
                    flat = int(change[0]) if len(change) else len(x)
                    rows.append((run, c, first, len(x), x.max(), x.min(), x[0], x[-1], flat, x[flat] if flat < len(x) else np.nan))
                yield pd.DataFrame(rows, columns=NAMES)

        n = chunks.count()
        if n > MOST_CHUNKS:
            raise ValueError(f"{n} chunks are too many for their table: take larger ones")
        got = chunks.mapInPandas(summary, "_run string, _chunk long, _first long, n long, high double, low double, head double, tail double, flat long, after double").toPandas()
        self.runs = {run: g.sort_values("_chunk").reset_index(drop=True) for run, g in got.groupby("_run", sort=False)}
        for run, g in self.runs.items():
            gaps = g["_first"].to_numpy()[1:] != (g["_first"] + g["n"]).to_numpy()[:-1]
            if gaps.any() or g["_first"].iloc[0] != 0 or (g["_chunk"].to_numpy() != np.arange(len(g))).any():
                raise ValueError(f"the samples of {run} don't run from 0 without gaps or repeats")
        self.columns = {run: {c: g[c].to_numpy() for c in NAMES[2:]} for run, g in self.runs.items()}

    def before(self, run: str, chunk: int, hit: Callable[[dict], np.ndarray], back: bool) -> int:
        """The nearest chunk before (or after) this one for which ``hit`` holds, -1 if there's none."""
        t, step = self.columns[run], 64
        n = len(t["n"])
        at = chunk - 1 if back else chunk + 1
        while 0 <= at < n:
            lo, hi = (max(0, at - step + 1), at + 1) if back else (at, min(n, at + step))
            found = np.flatnonzero(hit({k: v[lo:hi] for k, v in t.items()}))
            if len(found):
                return int(lo + (found[-1] if back else found[0]))
            at, step = (lo - 1 if back else hi), step * 2
        return -1


NAMES = ["_run", "_chunk", "_first", "n", "high", "low", "head", "tail", "flat", "after"]


def chunked(df: DataFrame, value: str, run: str, ix: str, size: int) -> DataFrame:
    """``_run, _chunk, _first, _x``: stretches of ``size`` samples in order of ``ix``, written. A null or NaN sample is an error."""
    x = F.col(value).cast("double")
    ok = F.assert_true(x.isNotNull() & ~F.isnan(x), F.lit("a sample is missing"))
    rows = df.select(F.col(run).cast("string").alias("_run"), F.col(ix).cast("long").alias("_ix"), F.when(ok.isNull(), x).alias("_v"))
    grouped = rows.groupBy("_run", F.floor(F.col("_ix") / size).alias("_chunk")).agg(F.min("_ix").alias("_first"), F.sort_array(F.collect_list(F.struct("_ix", "_v"))).alias("_s"))
    whole = F.assert_true(F.forall(F.transform("_s", lambda s, i: s["_ix"] - i), lambda first: first == F.col("_first")), F.lit("samples have gaps or repeats"))
    return cut(grouped.select("_run", "_chunk", "_first", F.when(whole.isNull(), F.transform("_s", lambda s: s["_v"])).alias("_x")))


def _maxima(x: np.ndarray, before: float, t: dict, chunk: int) -> Iterator[tuple[int, int]]:
    """First and last place (in the chunk's own count) of the flat or pointed tops that rise in this chunk and fall again, here or later."""
    rise = np.flatnonzero(np.diff(x, prepend=before) > 0)  # a NaN before the first sample rises nowhere
    change = np.append(np.flatnonzero(np.diff(x) != 0), -1)
    for s in rise:
        k = np.searchsorted(change[:-1], s)
        if k < len(change) - 1:
            e = int(change[k])
            if x[e + 1] < x[s]:
                yield int(s), e
            continue
        e, at = len(x) - 1, chunk + 1
        while at < len(t["n"]) and t["head"][at] == x[s]:
            e += int(t["flat"][at])
            if t["flat"][at] < t["n"][at]:
                break
            at += 1
        else:
            if at < len(t["n"]) and t["head"][at] < x[s]:
                yield int(s), e
            continue
        if t["after"][at] < x[s]:
            yield int(s), e


def local_maxima(chunks: DataFrame, table: Table, height: Limits, plateau: Limits) -> DataFrame:
    """``_run, peak, start, end, height``: tops in the middle, their first and last sample; the ends of a series are none."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for run, c, first, raw in zip(batch["_run"], batch["_chunk"], batch["_first"], batch["_x"]):
                x, t = np.asarray(raw, float), table.columns[run]
                rows += [(run, first + (s + e) // 2, first + s, first + e, x[s]) for s, e in _maxima(x, t["tail"][c - 1] if c else np.nan, t, c)]
            yield pd.DataFrame(rows, columns=["_run", "peak", "start", "end", "height"])

    found = chunks.mapInPandas(find, "_run string, peak long, start long, end long, height double").withColumn("plateau_size", F.col("end") - F.col("start") + 1)
    return found.where(_within("plateau_size", plateau) & _within("height", height))


def apart(peaks: DataFrame, distance: float, size: int, max_rounds: int = 200) -> DataFrame:
    """Of peaks nearer than ``distance`` samples the higher stays, of equal ones the later.

    Each round keeps the peaks that are highest among all undecided ones near them and drops those near a kept
    one, over blocks of places that overlap by the distance.
    """
    d = int(np.ceil(distance))
    if d <= 1:
        return peaks
    block = max(size, 4 * d)
    state = cut(peaks.withColumn("_state", F.lit(0)))  # 0 undecided, 1 kept
    near = Window.partitionBy("_run", "_block").orderBy("peak").rangeBetween(-(d - 1), d - 1)
    home = F.floor(F.col("peak") / block)
    blocks = F.array_distinct(F.array(home, F.floor((F.col("peak") - d) / block), F.floor((F.col("peak") + d) / block)))
    for _ in range(max_rounds):
        copies = state.withColumn("_block", F.explode(blocks))
        rank = F.when(F.col("_state") == 0, F.struct("height", "peak"))
        best = copies.withColumn("_top", F.max(rank).over(near) == rank)
        # a copy outside its own block sees only a part of what is near it: its claim counts only at home
        settled = best.where(F.col("_block") == home).drop("_block").withColumn("_state", F.when((F.col("_state") == 1) | F.col("_top"), 1).otherwise(0)).drop("_top")
        seen = settled.withColumn("_block", F.explode(blocks)).withColumn("_kept", F.max("_state").over(near)).where(F.col("_block") == home)
        state = cut(seen.where((F.col("_state") == 1) | (F.col("_kept") == 0)).drop("_block", "_kept"))
        if state.where("_state = 0").isEmpty():
            return state.drop("_state")
    raise RuntimeError(f"peaks are not told apart after {max_rounds} rounds")


def _asked(chunks: DataFrame, questions: DataFrame, answer: Callable[[str, int, int, np.ndarray, pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """Each chunk with all questions ``(_run, _chunk, ...)`` that it has, as ``answer(run, chunk, first, x, questions)`` gives them."""
    names = [c for c in questions.columns if c not in ("_run", "_chunk")]
    held = questions.groupBy("_run", "_chunk").agg(F.collect_list(F.struct(*names)).alias("_q"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for run, c, first, raw, q in zip(batch["_run"], batch["_chunk"], batch["_first"], batch["_x"], batch["_q"]):
                rows += answer(run, c, first, np.asarray(raw, float), pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in q], columns=names))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return chunks.join(held, ["_run", "_chunk"]).select("_run", "_chunk", "_first", "_x", "_q").mapInPandas(work, schema)


def _reach(x: np.ndarray, at: np.ndarray, hit: Callable[[np.ndarray, float], np.ndarray], level: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it where ``hit`` holds of the sample and its level, -1 if none: by growing stretches."""
    out = np.full(len(at), -1)
    for n, (p, h) in enumerate(zip(at, level)):
        end, step = int(p), 32
        while end > 0:
            start = max(0, end - step)
            found = np.flatnonzero(hit(x[start:end], h))
            if len(found):
                out[n] = start + found[-1]
                break
            end, step = start, step * 2
    return out


_SIDE = "_run string, peak long, side int, low double, _chunk long, height double"


def prominences(chunks: DataFrame, table: Table, peaks: DataFrame, size: int) -> DataFrame:
    """``peaks`` with ``_low`` and ``prominence``: the height over the higher of the two lowest levels before the series rises above the peak."""

    def own(run: str, c: int, first: int, x: np.ndarray, q: pd.DataFrame) -> list[tuple]:
        rows = []
        for side in (0, 1):
            y = x if side == 0 else x[::-1]
            at = (q["peak"] - first).to_numpy() if side == 0 else len(x) - 1 - (q["peak"] - first).to_numpy()
            higher = _reach(y, at, lambda v, h: v > h, q["height"].to_numpy())
            for p, h, a, g in zip(q["peak"], q["height"], at, higher):
                low, to = y[max(g, 0) : a + 1].min(), -1
                if g < 0:
                    t = table.columns[run]
                    to = table.before(run, c, lambda s: s["high"] > h, side == 0)
                    between = t["low"][to + 1 : c] if side == 0 else t["low"][c + 1 : to if to >= 0 else None]
                    low = min(low, between.min()) if len(between) else low
                rows.append((run, p, side, low, to, h))
        return rows

    def other(run: str, c: int, first: int, x: np.ndarray, q: pd.DataFrame) -> list[tuple]:
        rows = []
        for side, part in q.groupby("side"):
            y = x if side == 0 else x[::-1]
            last = np.maximum.accumulate(y[::-1])[::-1]  # the highest from here to the end that faces the peak
            least = np.append(np.minimum.accumulate(y[::-1])[::-1], np.inf)
            at = len(y) - np.searchsorted(last[::-1], part["height"].to_numpy(), "right")  # places whose rest rises above
            rows += [(run, p, side, min(low, least[a]), -1, h) for p, low, h, a in zip(part["peak"], part["low"], part["height"], at)]
        return rows

    home = peaks.select("_run", F.floor(F.col("peak") / size).alias("_chunk"), "peak", "height")
    sides = cut(_asked(chunks, home, own, _SIDE))
    rest = _asked(chunks, sides.where("_chunk >= 0").select("_run", "_chunk", "peak", "side", "low", "height"), other, _SIDE)
    lows = sides.where("_chunk < 0").unionByName(rest).groupBy("_run", "peak").agg(F.max("low").alias("_low"))
    return cut(peaks.join(lows, ["_run", "peak"]).withColumn("prominence", F.col("height") - F.col("_low")))


_CROSS = "_run string, peak long, side int, place double, _chunk long, level double"


def widths(chunks: DataFrame, table: Table, peaks: DataFrame, size: int, rel_height: float) -> DataFrame:
    """``peaks`` with ``left``, ``right`` (interpolated places) and ``width`` at ``rel_height`` of the prominence below the top."""

    def place(side: int, first: int, n: int, i: int, x_i: float, x_next: float, level: float) -> float:
        """``i`` counts from the end that the search started at; ``x_next`` is the sample one nearer to the peak."""
        part = (level - x_i) / (x_next - x_i) if x_i < level else 0.0
        return first + i + part if side == 0 else first + n - 1 - (i + part)

    def own(run: str, c: int, first: int, x: np.ndarray, q: pd.DataFrame) -> list[tuple]:
        rows = []
        for side in (0, 1):
            y = x if side == 0 else x[::-1]
            at = (q["peak"] - first).to_numpy() if side == 0 else len(x) - 1 - (q["peak"] - first).to_numpy()
            found = _reach(y, at + 1, lambda v, h: v <= h, q["level"].to_numpy())
            for p, h, a, i in zip(q["peak"], q["level"], at, found):
                if i >= 0:
                    rows.append((run, p, side, place(side, first, len(x), int(i), y[i], y[min(i + 1, a)], h), -1, h))
                else:
                    rows.append((run, p, side, np.nan, table.before(run, c, lambda s: s["low"] <= h, side == 0), h))
        return rows

    def other(run: str, c: int, first: int, x: np.ndarray, q: pd.DataFrame) -> list[tuple]:
        rows, t = [], table.columns[run]
        for side, part in q.groupby("side"):
            y = x if side == 0 else x[::-1]
            beyond = t["head"][c + 1] if side == 0 else t["tail"][c - 1]
            found = _reach(y, np.full(len(part), len(y)), lambda v, h: v <= h, part["level"].to_numpy())
            rows += [(run, p, side, place(side, first, len(x), int(i), y[i], y[i + 1] if i + 1 < len(y) else beyond, h), -1, h) for p, h, i in zip(part["peak"], part["level"], found)]
        return rows

    home = peaks.select("_run", F.floor(F.col("peak") / size).alias("_chunk"), "peak", F.greatest(F.col("height") - F.col("prominence") * rel_height, F.col("_low")).alias("level"))
    sides = cut(_asked(chunks, home, own, _CROSS))
    rest = _asked(chunks, sides.where("_chunk >= 0").select("_run", "_chunk", "peak", "side", "level"), other, _CROSS)
    ends = sides.where("_chunk < 0").unionByName(rest).groupBy("_run", "peak").agg(*[F.max(F.when(F.col("side") == s, F.col("place"))).alias(n) for s, n in ((0, "left"), (1, "right"))])
    return peaks.join(ends, ["_run", "peak"]).withColumn("width", F.col("right") - F.col("left"))


def windowed(chunks: DataFrame, peaks: DataFrame, size: int, wlen: int, rel_height: float) -> DataFrame:
    """``peaks`` with ``prominence``, ``left``, ``right`` and ``width``, looking no further than half of ``wlen`` samples: a chunk and its neighbours."""
    half = int(wlen) // 2

    def answer(run: str, c: int, first: int, x: np.ndarray, q: pd.DataFrame) -> list[tuple]:
        rows = []
        for p, h in zip(q["peak"], q["height"]):
            lows, a = [], int(p - first)
            for y, at in ((x[max(0, a - half) : a + 1][::-1], 0), (x[a : a + half + 1], 1)):
                over = np.flatnonzero(y > h)
                lows.append(y[: over[0] if len(over) else None].min())
            prominence = h - max(lows)
            level, ends = max(h - prominence * rel_height, max(lows)), []
            for y, sign in ((x[max(0, a - half) : a + 1][::-1], -1), (x[a : a + half + 1], 1)):
                i = int(np.flatnonzero(y <= level)[0])
                ends.append(p + sign * (i - ((level - y[i]) / (y[i - 1] - y[i]) if y[i] < level else 0.0)))
            rows.append((run, p, prominence, ends[0], ends[1]))
        return rows

    c = F.col("_chunk")
    beside = chunks.select("_run", F.explode(F.array(c - 1, c, c + 1)).alias("_chunk"), F.struct("_first", "_x").alias("_p"))
    wide = beside.groupBy("_run", "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    wide = wide.select("_run", "_chunk", F.get("_p", F.lit(0))["_first"].alias("_first"), F.flatten(F.transform("_p", lambda p: p["_x"])).alias("_x"))
    home = peaks.select("_run", F.floor(F.col("peak") / size).alias("_chunk"), "peak", "height")
    found = _asked(wide, home, answer, "_run string, peak long, prominence double, left double, right double")
    return peaks.join(found, ["_run", "peak"]).withColumn("width", F.col("right") - F.col("left"))


def numbered(df: DataFrame, order: Sequence[str], name: str = "ix") -> DataFrame:
    """``df`` with each row's place in the order, from 0: rows are dealt out by ranges, and each range counts on from those before it."""
    ordered = cut(df.orderBy(*order))
    at = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    tagged = ordered.withColumns({"_range": F.shiftright(at, 33), name: at.bitwiseAND(F.lit((1 << 33) - 1))})
    starts, n = [], 0
    for k, size in sorted(tuple(r) for r in tagged.groupBy("_range").count().collect()):  # one row a task
        starts.append((k, n))
        n += size
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_range long, _n long"))
    return tagged.join(before, "_range").withColumn(name, F.col(name) + F.col("_n")).drop("_range", "_n")


def find_peaks(
    df: DataFrame, value: str, run: str, ix: str, height: Limits = None, plateau_size: Limits = None, distance: float | None = None,
    prominence: Limits = None, width: Limits = None, wlen: int | None = None, rel_height: float = 0.5, chunk: int = CHUNK,
) -> DataFrame:
    """``run, ix, height, plateau_size, prominence, left, right, width`` of the peaks of each series (``ix`` from 0 without gaps).

    A peak is a sample, or the middle of equal ones, higher than what comes before and after. The limits are a
    least value or a pair (None for no bound) and apply in the order: plateau, height, distance, prominence, width.
    The two ends of a series are no peaks; a series of fewer than three samples has none. ``rel_height`` is from 0 to 1.
    """
    if not 0 <= rel_height <= 1 or distance is not None and distance < 1 or wlen is not None and wlen < 2:
        raise ValueError("need 0 <= rel_height <= 1, distance >= 1 and wlen >= 2")
    size = max(chunk, wlen or 0)
    chunks = chunked(df, value, run, ix, size)
    table = Table(chunks)
    found = local_maxima(chunks, table, height, plateau_size)
    if distance is not None:
        found = apart(found, distance, size)
    found = cut(found)
    if wlen is not None:
        found = windowed(chunks, found, size, wlen, rel_height).where(_within("prominence", prominence))
    else:
        found = widths(chunks, table, prominences(chunks, table, found, size).where(_within("prominence", prominence)), size, rel_height)
    kind = df.schema[run].dataType
    return found.where(_within("width", width)).select(F.col("_run").cast(kind).alias(run), F.col("peak").alias(ix), "height", "plateau_size", "prominence", "left", "right", "width")
