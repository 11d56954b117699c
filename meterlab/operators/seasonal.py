"""Seasonal-trend decomposition of one series, the helper inside grouped tasks.

Local regression after Cleveland et al. (1990) and the multi-period loop of
Bandara, Hyndman and Bergmeir (2021).  Spark partitions the series; this file
only handles the single array a task has in hand.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

# Smoothing defaults of the published procedure.
SEASONAL_WINDOWS = (11, 15, 19, 23, 27, 31)
PASSES = 2


@dataclass
class Parts:
    trend: np.ndarray
    seasonal: dict[int, np.ndarray]
    remainder: np.ndarray


def _odd_at_least(x: float) -> int:
    n = int(np.ceil(x))
    return n + 1 - n % 2


_KNOWN_WINDOWS: dict[tuple[int, int, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _windows(n: int, window: int, jump: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evaluation points, neighbour indices and tricube weights on a unit grid.

    ``pad`` adds one evaluation point before the first and after the last one.
    Passes over one series, and series of equal length, share the result.
    """
    known = _KNOWN_WINDOWS.get((n, window, jump, pad))
    if known is not None:
        return known
    width = min(window, n)
    step = max(1, min(jump, n - 1))
    points = np.unique(np.append(np.arange(0, n, step), n - 1))
    if pad:
        points = np.concatenate(([-1], points, [n]))
    first = np.clip(points - (width + 1) // 2 + 1, 0, n - width)
    index = first[:, None] + np.arange(width)
    reach = np.maximum(points - first, first + width - 1 - points).astype(float)
    if window > n:
        reach += (window - n) // 2
    distance = np.abs(index - points[:, None])
    ratio = distance / np.where(reach > 0, reach, 1.0)[:, None]
    weight = np.where(ratio <= .001, 1.0, np.where(ratio <= .999, (1 - ratio ** 3) ** 3, 0.0))
    if len(_KNOWN_WINDOWS) >= 64:
        _KNOWN_WINDOWS.clear()
    _KNOWN_WINDOWS[n, window, jump, pad] = points, index, weight
    return points, index, weight


def _smooth(y: np.ndarray, window: int, degree: int, jump: int, pad: int = 0,
            trust: np.ndarray | None = None) -> np.ndarray:
    """Local regression of every row of ``y``; linear interpolation between jumps."""
    n = y.shape[1]
    if n < 2:
        return np.repeat(y, 1 + 2 * pad, axis=1)
    points, index, weight = _windows(n, window, jump, pad)
    w = np.broadcast_to(weight, (1, *weight.shape)) if trust is None else weight * trust[:, index]
    total = w.sum(axis=2, keepdims=True)
    w = w / np.where(total > 0, total, 1.0)
    if degree:
        at = index.astype(float)
        centre = (w * at).sum(axis=2, keepdims=True)
        spread = (w * (at - centre) ** 2).sum(axis=2, keepdims=True)
        tilt = np.where(np.sqrt(spread) > .001 * (n - 1),
                        (points[None, :, None] - centre) / np.where(spread > 0, spread, 1.0), 0.0)
        w = w * (1 + tilt * (at - centre))
    fit = (w * y[:, index]).sum(axis=2)
    if trust is not None:
        flat = np.broadcast_to(total[:, :, 0] <= 0, fit.shape)
        fit = np.where(flat, y[:, np.clip(points, 0, n - 1)], fit)
    grid = np.arange(-pad, n + pad)
    if len(points) == len(grid):
        return fit
    return np.stack([np.interp(grid, points, row) for row in fit])


def _moving_mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(x)))
    return (total[width:] - total[:-width]) / width


def _jump(window: int) -> int:
    return -(-window // 10)


def _cycle_smooth(x: np.ndarray, period: int, window: int, trust: np.ndarray | None) -> np.ndarray:
    """Smooth each position of the cycle over its repetitions, one cycle wider at both ends."""
    n = len(x)
    out = np.empty(n + 2 * period)
    # Positions of the cycle come in at most two lengths; handle each length at once.
    lengths = np.array([len(range(j, n, period)) for j in range(period)])
    for k in np.unique(lengths):
        js = np.flatnonzero(lengths == k)
        index = js[:, None] + period * np.arange(k)
        part = _smooth(x[index], window, 0, _jump(window), pad=1, trust=None if trust is None else trust[index])
        out[js[:, None] + period * np.arange(k + 2)] = part
    return out


def seasonal_trend(x: np.ndarray, period: int, window: int, robust: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal and trend components of a complete series."""
    trend_window = _odd_at_least(1.5 * period / (1 - 1.5 / window))
    low_window = _odd_at_least(period)
    n = len(x)
    trend, season, trust = np.zeros(n), np.zeros(n), None
    rounds, inner = (16, 1) if robust else (1, 2)
    for _ in range(rounds):
        for _ in range(inner):
            cycle = _cycle_smooth(x - trend, period, window, trust)
            low = _moving_mean(_moving_mean(_moving_mean(cycle, period), period), 3)
            low = _smooth(low[None, :], low_window, 1, _jump(low_window))[0]
            season = cycle[period:period + n] - low
            trend = _smooth((x - season)[None, :], trend_window, 1, _jump(trend_window),
                            trust=None if trust is None else trust[None, :])[0]
        if robust:
            miss = np.abs(x - season - trend)
            scale = 6 * np.median(miss)
            u = miss / scale if scale > 0 else np.zeros(n)
            trust = np.where(u <= .001, 1.0, np.where(u <= .999, (1 - u ** 2) ** 2, 0.0))
    return season, trend


def decompose(x: np.ndarray, periods: Sequence[int], robust: bool = False) -> Parts:
    """Trend, one seasonal part per period, remainder; the parts add up to ``x``.

    Missing values are interpolated linearly for the fit.  Periods with fewer
    than two full cycles are skipped (their part is 0); if none is left the
    trend is a plain local line.
    """
    x = np.asarray(x, dtype=float)
    n, known = len(x), np.isfinite(x)
    parts = {p: np.zeros(n) for p in periods}
    if not known.any():
        return Parts(np.full(n, np.nan), parts, np.full(n, np.nan))
    filled = x if known.all() else np.interp(np.arange(n), np.flatnonzero(known), x[known])
    used = [p for p in sorted(periods) if 1 < p < n / 2]
    rest, trend = filled.copy(), None
    for _ in range(PASSES):
        for rank, p in enumerate(used):
            rest = rest + parts[p]
            window = SEASONAL_WINDOWS[min(rank, len(SEASONAL_WINDOWS) - 1)]
            parts[p], trend = seasonal_trend(rest, p, window, robust)
            rest = rest - parts[p]
    if trend is None:
        trend = _smooth(filled[None, :], _odd_at_least(max(7, n / 2)), 1, 1)[0]
    return Parts(trend, parts, rest - trend)
