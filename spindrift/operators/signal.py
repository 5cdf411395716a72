"""Signal cleaning: per voxel (rows with an array) map-only, per physiological run by grouped maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .peaks import chunked


def clean_voxels(voxels: DataFrame, tr: float, high_pass: float | None = 0.01, low_pass: float | None = None, order: int = 4, trim: int = 0, linear: bool = True, scale: bool = True, ts: str = "ts") -> DataFrame:
    """``ts`` of each row trimmed, detrended, filtered without phase shift and standardised. No shuffle.

    Filters a batch of equally long series at once. A constant series becomes zeros.
    """
    rate = 1 / tr
    kind = "band" if high_pass and low_pass else "high" if high_pass else "low"
    cut = (high_pass, low_pass) if kind == "band" else high_pass or low_pass
    sections = K.butterworth(order, cut, rate, kind) if cut else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = {}
            lengths = batch[ts].map(len)
            for n, part in batch.groupby(lengths):
                if n <= trim:
                    done |= dict.fromkeys(part.index, np.zeros(0))
                    continue
                x = np.stack(part[ts].to_numpy()).astype(float).T[trim:]
                x = K.detrend(x) if linear else x
                x = K.zero_phase(sections, x) if sections is not None else x
                x = K.standardise(x) if scale else x
                done |= dict(zip(part.index, x.T))
            yield batch.assign(**{ts: [done[i] for i in batch.index]})

    return voxels.mapInPandas(work, voxels.schema)


def run_map(df: DataFrame, by: str, order: str, columns: list[str], out: str, f) -> DataFrame:
    """``f(x: array of samples by column) -> frame`` for each run (one scan's recording), in order."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        got = f(pdf[columns].to_numpy(float))
        got.insert(0, by, pdf[by].iloc[0])
        return got

    kind = df.schema[by].dataType.simpleString()
    return df.select(by, order, *columns).groupBy(by).applyInPandas(work, f"`{by}` {kind}, {out}")


def end_tidal(df: DataFrame, by: str, order: str, value: str, rate: float, inverted: bool = False) -> DataFrame:
    """Breath-by-breath peaks of a gas trace, interpolated to every sample; ``inverted`` takes the troughs.

    Band-passed 0.1 to 0.4 Hz; peaks at or above the median, 1.5 s apart at least. Inverted: the first
    peak takes the second one's height. A run without peaks gives its mean.
    """

    def f(x: np.ndarray) -> pd.DataFrame:
        x = -x[:, 0] if inverted else x[:, 0]
        y = K.zero_phase(K.butterworth(4, (0.1, 0.4), rate, "band"), x)
        p = K.find_peaks(y, np.median(y), 1.5 * rate)
        if not len(p):
            got = np.full(len(x), x.mean())
        else:
            h = x[p].copy()
            if inverted and len(h) > 1:
                h[0] = h[1]
            got = K.pchip(p.astype(float), h, np.clip(np.arange(len(x)), p[0], p[-1]).astype(float))
        return pd.DataFrame({"ix": np.arange(len(x)), "value": -got if inverted else got})

    return run_map(df, by, order, [value], "ix int, value double", f)


def pulse_features(df: DataFrame, by: str, order: str, value: str, rate: float) -> DataFrame:
    """``ix, heart_rate, ppg_amplitude``: beats a minute and height of the beats, interpolated to every sample."""

    def f(x: np.ndarray) -> pd.DataFrame:
        y = K.zero_phase(K.butterworth(3, (0.5, min(8.0, 0.45 * rate)), rate, "band"), x[:, 0])
        p = K.find_peaks(y, np.median(y), 0.4 * rate)
        n = np.arange(len(y), dtype=float)
        if len(p) < 3:
            return pd.DataFrame({"ix": n.astype(int), "heart_rate": np.nan, "ppg_amplitude": np.nan})
        inside = np.clip(n, p[1], p[-1])
        bpm = K.pchip(p[1:].astype(float), 60 * rate / np.diff(p), inside)
        return pd.DataFrame({"ix": n.astype(int), "heart_rate": bpm, "ppg_amplitude": K.pchip(p.astype(float), np.abs(y[p]), np.clip(n, p[0], p[-1]))})

    return run_map(df, by, order, [value], "ix int, heart_rate double, ppg_amplitude double", f)


def respiration_features(df: DataFrame, by: str, order: str, value: str, rate: float) -> DataFrame:
    """``ix, resp_amp, resp_rate, resp_rvt``: depth from trough to peak, breaths a minute, depth over period."""

    def f(x: np.ndarray) -> pd.DataFrame:
        y = K.zero_phase(K.butterworth(2, (0.05, min(3.0, 0.45 * rate)), rate, "band"), x[:, 0])
        up, down = K.find_peaks(y, np.median(y), 1.5 * rate), K.find_peaks(-y, np.median(-y), 1.5 * rate)
        n = np.arange(len(y), dtype=float)
        if len(up) < 3 or len(down) < 2:
            return pd.DataFrame({"ix": n.astype(int), "resp_amp": np.nan, "resp_rate": np.nan, "resp_rvt": np.nan})
        top = K.pchip(up.astype(float), y[up], np.clip(n, up[0], up[-1]))
        low = K.pchip(down.astype(float), y[down], np.clip(n, down[0], down[-1]))
        period = K.pchip(up[1:].astype(float), np.diff(up) / rate, np.clip(n, up[1], up[-1]))
        return pd.DataFrame({"ix": n.astype(int), "resp_amp": top - low, "resp_rate": 60 / period, "resp_rvt": (top - low) / period})

    return run_map(df, by, order, [value], "ix int, resp_amp double, resp_rate double, resp_rvt double", f)


#: What each recorded column yields.
FEATURES = {
    "cardiac": lambda df, by, order, rate: pulse_features(df, by, order, "cardiac", rate),
    "respiratory_effort": lambda df, by, order, rate: respiration_features(df, by, order, "respiratory_effort", rate),
    "respiratory_CO2": lambda df, by, order, rate: end_tidal(df, by, order, "respiratory_CO2", rate).withColumnRenamed("value", "endtidal_co2"),
    "respiratory_O2": lambda df, by, order, rate: end_tidal(df, by, order, "respiratory_O2", rate, inverted=True).withColumnRenamed("value", "endtidal_o2"),
}


def to_frames(df: DataFrame, by: str, columns: list[str], rate: float, tr: float, n_volumes: int | None, reference: float = 0.5, high_pass: float = 0.01) -> DataFrame:
    """Each feature at the scan's frame times ``(t + reference) tr``: low-pass, monotone cubic, high-pass, z-score.

    Without ``n_volumes`` each run has as many frames as its recording covers.
    """

    def f(x: np.ndarray) -> pd.DataFrame:
        frames = np.arange(int(len(x) / rate / tr + 1e-9) if n_volumes is None else n_volumes)
        at = (frames + reference) * tr
        out = {"t": frames}
        for c, v in zip(columns, x.T):
            limit = 1 / (2 * tr) + 0.05
            v = K.zero_phase(K.butterworth(4, limit, rate), v) if limit < rate / 2 else v
            y = K.pchip(np.arange(len(v)) / rate, v, np.clip(at, 0, (len(v) - 1) / rate))
            y = K.zero_phase(K.butterworth(4, high_pass, 1 / tr, "high"), y)
            out[c] = K.standardise(y)
        return pd.DataFrame(out)

    return run_map(df, by, "ix", columns, "t int, " + ", ".join(f"`{c}` double" for c in columns), f)


def process_physio(df: DataFrame, by: str, columns: list[str], rate: float, tr: float, n_volumes: int | None, to: float = 50.0, reference: float = 0.5) -> DataFrame:
    """Recording to features at frame times: resample, extract by column name, interpolate. Unknown columns are skipped."""
    known = [c for c in columns if c in FEATURES]

    def f(x: np.ndarray) -> pd.DataFrame:
        y = np.column_stack([K.resample(v, rate, to) for v in x.T])
        return pd.DataFrame({"ix": np.arange(len(y)), **dict(zip(known, y.T))})

    even = run_map(df, by, "ix", known, "ix int, " + ", ".join(f"`{c}` double" for c in known), f)
    parts = [FEATURES[c](even, by, "ix", to) for c in known]
    wide = parts[0]
    for p in parts[1:]:
        wide = wide.join(p, [by, "ix"])
    return to_frames(wide, by, [c for c in wide.columns if c not in (by, "ix")], to, tr, n_volumes, reference)


def peak_table(df: DataFrame, by: str, order: str, value: str, **limits) -> DataFrame:
    """``ix, height`` of each run's peaks with distance, prominence and number limits."""

    def f(x: np.ndarray) -> pd.DataFrame:
        p = K.find_peaks(x[:, 0], **limits)
        return pd.DataFrame({"ix": p, "height": x[p, 0]})

    return run_map(df, by, order, [value], "ix int, height double", f)


def smooth(voxels: DataFrame, fwhm: float, size: float) -> DataFrame:
    """``i, j, k, x``: Gaussian smoothing over neighbours within three deviations, weights renewed at the mask's edge.

    The kernel is a product of three, one for each axis, so values and weights are summed along one axis after
    the other: a voxel is sent to a few neighbours of its line (their number is set by ``fwhm / size`` alone).
    """
    sigma = fwhm / 2.3548 / size
    r = int(np.ceil(3 * sigma))
    if not r:
        return voxels
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(np.exp(-d * d / (2 * sigma * sigma)))).alias("g")) for d in range(-r, r + 1)])
    axes = ("i", "j", "k")
    sums = voxels.select(*axes, F.lit(1.0).alias("w"), F.col("x").alias("wx"))
    for axis in axes:
        sent = sums.select(*axes, "w", "wx", F.explode(steps).alias("s"))
        to = [(F.col(c) + F.col("s.d")).alias(c) if c == axis else F.col(c) for c in axes]
        sums = sent.groupBy(*to).agg(F.sum(F.col("w") * F.col("s.g")).alias("w"), F.sum(F.col("wx") * F.col("s.g")).alias("wx"))
    return sums.select(*axes, (F.col("wx") / F.col("w")).alias("x")).join(voxels.select(*axes), list(axes), "left_semi")


def resampled(df: DataFrame, value: str, run: str, ix: str, up: int, down: int, chunk: int = 1 << 16) -> DataFrame:
    """``run, ix, value`` of each series (``ix`` from 0 without gaps) at ``up / down`` of its rate, a chunk and what the filter reaches of its neighbours in a task.

    Equal to the whole series in one piece, of which n samples give ceil(n up / down). Before and after it lie zeros.
    """
    if up < 1 or down < 1:
        raise ValueError("up and down must be 1 or more")
    common = int(np.gcd(up, down))
    u, d = up // common, down // common
    reach = 10 * max(u, d) // u + 2
    size = max(chunk, reach)
    c = F.col("_chunk")
    chunks = chunked(df, value, run, ix, size)
    last = chunks.groupBy("_run").agg(F.max(F.col("_first") + F.size("_x")).alias("_n"))
    beside = chunks.select("_run", F.explode(F.array(c - 1, c, c + 1)).alias("_chunk"), F.struct("_first", "_x").alias("_p"))
    wide = beside.groupBy("_run", "_chunk").agg(F.sort_array(F.collect_list("_p")).alias("_p")).join(last, "_run")
    wide = wide.where((c >= 0) & (c * size < F.col("_n")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, k, parts, n in zip(batch["_run"], batch["_chunk"], batch["_p"], batch["_n"]):
                parts = [p if isinstance(p, dict) else p.asDict() for p in parts]
                x = np.concatenate([np.asarray(p["_x"], float) for p in parts])
                start, stop = -(-int(k) * size * u // d), -(-min((int(k) + 1) * size, int(n)) * u // d)
                y = K.polyphase(x, u, d, int(parts[0]["_first"]), start, stop)
                yield pd.DataFrame({"_run": name, ix: np.arange(start, stop), value: y})

    out = wide.select("_run", "_chunk", "_p", "_n").mapInPandas(work, f"_run string, `{ix}` long, `{value}` double")
    return out.select(F.col("_run").cast(df.schema[run].dataType).alias(run), ix, value)
