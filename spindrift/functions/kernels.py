"""Small numeric helpers for one run's arrays, used inside grouped-map functions."""

from __future__ import annotations

import numpy as np


def butterworth(order: int, cut: float | tuple[float, float], rate: float, kind: str = "low") -> np.ndarray:
    """Second-order sections of a digital Butterworth filter (``low``, ``high`` or ``band``) by the bilinear transform."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    p = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind == "band":
        lo, hi = map(warp, cut)
        width, centre = hi - lo, np.sqrt(hi * lo)
        half = p * width / 2
        root = np.sqrt(half**2 - centre**2 + 0j)
        poles, zeros, gain = np.concatenate([half + root, half - root]), np.zeros(order), width**order
    elif kind == "high":
        w = warp(cut)
        poles, zeros, gain = w / p, np.zeros(order), 1.0
        gain = float(np.real(1 / np.prod(-p))) if order else 1.0
    elif kind == "low":
        w = warp(cut)
        poles, zeros, gain = p * w, np.zeros(0), w**order
    else:
        raise ValueError("kind must be low, high or band")
    fs2 = 2 * rate
    z = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(len(poles) - len(zeros))])
    d = (fs2 + poles) / (fs2 - poles)
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    pairs = sorted(d[d.imag > 1e-12], key=lambda c: (abs(c), c.real))
    real = sorted(d[abs(d.imag) <= 1e-12].real, key=abs)
    denominators = [np.array([1, -2 * c.real, abs(c) ** 2]) for c in pairs]
    while real:
        a = real.pop()
        b = real.pop() if real else None
        denominators.append(np.array([1, -a, 0.0]) if b is None else np.array([1, -(a + b), a * b]))
    zs = sorted(np.real(z))
    sections = []
    for a in denominators:
        n = 1 if a[2] == 0 and len(zs) % 2 else 2
        own = [zs.pop(0), zs.pop(-1)] if n == 2 and len(zs) > 1 else [zs.pop(0)]
        b = np.poly(own)
        sections.append(np.concatenate([b, np.zeros(3 - len(b)), a]))
    sections[0][:3] *= gain
    return np.array(sections)


def _steady(section: np.ndarray) -> np.ndarray:
    b, a = section[:3], section[3:]
    m = np.eye(2) - np.array([[-a[1], 1], [-a[2], 0]])
    return np.linalg.solve(m, np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]]))


def _once(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Direct form II transposed along the first axis, from the state that a constant first value would leave."""
    y = x.copy()
    first = x[0].copy()
    for s in sections:
        b, a = s[:3], s[3:]
        z0, z1 = (v * first for v in _steady(s))
        first = first * b.sum() / a.sum()
        for t in range(len(y)):
            v = y[t].copy()
            out = b[0] * v + z0
            z0, z1 = b[1] * v - a[1] * out + z1, b[2] * v - a[2] * out
            y[t] = out
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of a series (or of columns), odd reflections at both ends."""
    x = np.asarray(x, float)
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    if pad < 1:
        return x.copy()
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return _once(sections, _once(sections, wide)[::-1])[::-1][pad:-pad]


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation: slopes are weighted harmonic means, 0 at turning points."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    if len(x) == 1:
        return np.full(len(at), y[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return y[0] + (at - x[0]) * d[0]
    m = np.zeros(len(x))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0.0)

    def edge(h0, h1, d0, d1):
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if np.sign(v) != np.sign(d0):
            return 0.0
        return 3 * d0 if np.sign(d0) != np.sign(d1) and abs(v) > 3 * abs(d0) else v

    m[0], m[-1] = edge(h[0], h[1], d[0], d[1]), edge(h[-1], h[-2], d[-1], d[-2])
    return _hermite(x, y, m, at)


def _hermite(x, y, m, at):
    j = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[j + 1] - x[j]
    s = (at - x[j]) / h
    return (1 + 2 * s) * (1 - s) ** 2 * y[j] + s * (1 - s) ** 2 * h * m[j] + s**2 * (3 - 2 * s) * y[j + 1] + s**2 * (s - 1) * h * m[j + 1]


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline interpolation with no break at the second and the last but one point."""
    x, y, at = (np.asarray(v, float) for v in (x, y, at))
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    a[0, :2] = h[1], h[0] + h[1]
    r[0] = ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:] = h[-1] + h[-2], h[-2]
    r[-1] = (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    return _hermite(x, y, np.linalg.solve(a, r), at)


def uniform_slopes(n: int) -> np.ndarray:
    """The matrix from ``n`` values a unit apart, 4 or more, to the slopes of ``cubic`` through them."""
    step = np.diff(np.eye(n), axis=0)
    a, r = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = 1, 4, 1
        r[i] = 3 * (step[i - 1] + step[i])
    a[0, :2] = a[-1, :-3:-1] = 1, 2
    r[0], r[-1] = (5 * step[0] + step[1]) / 2, (5 * step[-1] + step[-2]) / 2
    return np.linalg.solve(a, r)


def find_peaks(x: np.ndarray, height: float | None = None, distance: float | None = None, prominence: float | None = None, top: int | None = None) -> np.ndarray:
    """Places of local maxima (the middle of a flat top), at or above ``height``.

    Of peaks nearer than ``distance`` samples the higher stays; then those of less ``prominence`` go; then
    the ``top`` highest stay. In order of place.
    """
    x = np.asarray(x, float)
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    p = np.array(found, int)
    if height is not None:
        p = p[x[p] >= height]
    if distance is not None and len(p):
        keep = np.ones(len(p), bool)
        for k in np.argsort(x[p], kind="stable")[::-1]:
            if keep[k]:
                near = (np.abs(p - p[k]) < np.ceil(distance)) & (np.arange(len(p)) != k)
                keep &= ~near
        p = p[keep]
    if prominence is not None:
        p = np.array([k for k in p if _prominence(x, k) >= prominence], int)
    if top is not None and len(p) > top:
        p = np.sort(p[np.argsort(-x[p], kind="stable")[:top]])
    return p


def _prominence(x: np.ndarray, k: int) -> float:
    left, right = np.flatnonzero(x[:k] > x[k]), np.flatnonzero(x[k + 1 :] > x[k])
    a = left[-1] if len(left) else 0
    b = k + 1 + right[0] if len(right) else len(x) - 1
    return float(x[k] - max(x[a : k + 1].min(), x[k : b + 1].min()))


def polyphase_filter(up: int, down: int, beta: float = 5.0) -> np.ndarray:
    """The low-pass filter of a change of rate: a sinc of ten zero crossings a side in a Kaiser window, with a sum of ``up``."""
    most = max(up, down)
    half = 10 * most
    k = np.arange(-half, half + 1)
    h = np.sinc(k / most) * np.kaiser(2 * half + 1, beta)
    return up * h / h.sum()


def polyphase(x: np.ndarray, up: int, down: int, first: int = 0, start: int | None = None, stop: int | None = None) -> np.ndarray:
    """Samples ``start`` to ``stop`` of a series at ``up / down`` of its rate; ``x`` begins at sample ``first`` of it and is 0 outside.

    Each output sample meets one of the ``up`` phases of the filter: every ``up``-th coefficient, from where it lies
    between input samples. A stretch of the series gives the same samples as the whole if it holds all that the filter reaches.
    """
    x = np.asarray(x, float)
    common = np.gcd(up, down)
    up, down = up // common, down // common
    start, stop = start or 0, -(-(first + len(x)) * up // down) if stop is None else stop
    h = polyphase_filter(up, down)
    half = len(h) // 2
    taps = 2 * (half // up) + 2
    phases = np.zeros((up, taps))
    for p in range(up):  # input sample k0 - taps // 2 + 1 + i is (p + (taps // 2 - 1 - i) up) fine steps away
        j = half + p + (taps // 2 - 1 - np.arange(taps)) * up
        inside = (j >= 0) & (j < len(h))
        phases[p, inside] = h[j[inside]]
    padded = np.concatenate([np.zeros(taps), x, np.zeros(taps)])
    out = np.empty(max(0, stop - start))
    for a in range(0, len(out), 1 << 14):
        m = np.arange(start + a, min(start + a + (1 << 14), stop), dtype=np.int64) * down
        at = m // up - taps // 2 + 1 - first + taps
        where = np.clip(at[:, None] + np.arange(taps), 0, len(padded) - 1)
        out[a : a + len(m)] = (padded[where] * phases[m % up]).sum(1)
    return out


def resample(x: np.ndarray, rate: float, to: float) -> np.ndarray:
    """A series at another rate by ``polyphase``; as long as it lasted, to the nearest sample."""
    x = np.asarray(x, float)
    n = int(np.round(len(x) * to / rate))
    return polyphase(x, n, len(x), stop=n) if len(x) and n else np.zeros(n)


def detrend(x: np.ndarray) -> np.ndarray:
    """Less its least-squares line, along the first axis."""
    x = np.asarray(x, float)
    t = np.arange(len(x)) - (len(x) - 1) / 2
    slope = np.tensordot(t, x, 1) / max((t * t).sum(), 1e-12)
    return x - x.mean(0) - (t[:, None] * slope if x.ndim > 1 else t * slope)


def standardise(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return np.where(s > 0, (x - x.mean(0)) / np.where(s > 0, s, 1), 0.0)
