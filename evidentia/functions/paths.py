"""Numpy helpers over one series, or a block of them, held as arrays; Spark brings the arrays and takes the results."""

from __future__ import annotations

import math

import numpy as np

from evidentia.functions.measures import TINY_SD


class Order:
    """The k-th smallest value of any stretch of a sequence.

    Values become ranks. For each bit of the rank, highest first, the zeros before
    every place are counted and the sequence is put in the order of that bit. A
    question goes down one bit at a time, so that it costs the logarithm of the
    sequence whatever the length of the stretch, and all questions go down at once.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        rank = np.empty(len(values), np.int64)
        rank[order] = np.arange(len(values))
        self.zeros = []
        for bit in range(max(len(values) - 1, 1).bit_length() - 1, -1, -1):
            one = (rank >> bit & 1).astype(bool)
            self.zeros.append((bit, np.concatenate([[0], np.cumsum(~one)])))
            rank = np.concatenate([rank[~one], rank[one]])

    def smallest(self, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """By question, the value with ``k`` smaller ones (in rank) among places low to high."""
        k, value = np.full(len(low), k), np.zeros(len(low), np.int64)
        for bit, zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            right = k >= b - a
            k = np.where(right, k - (b - a), k)
            low, high = np.where(right, zeros[-1] + low - a, a), np.where(right, zeros[-1] + high - b, b)
            value |= right.astype(np.int64) << bit
        return self.sorted[value]


def between(n: int, p: float) -> tuple[int, int, float, float]:
    """The two order statistics around an interpolated quantile of n values, and their weights."""
    at = (n - 1) * p
    low, high = math.floor(at), math.ceil(at)
    return low, high, high - at if low < high else 1.0, at - low


def rolling_quantiles(values: np.ndarray, window: int, shares: list[float]) -> np.ndarray:
    """One row per share: for each place from ``window`` on, the interpolated quantile of the ``window`` values before it."""
    n = max(len(values) - window, 0)
    if not n:
        return np.zeros((len(shares), 0))
    order, low = Order(values), np.arange(n)
    out = []
    for p in shares:
        a, b, of_a, of_b = between(window, p)
        first = order.smallest(low, low + window, a)
        out.append(first if a == b else of_a * first + of_b * order.smallest(low, low + window, b))
    return np.array(out)


def window_products(factors: np.ndarray, width: int) -> np.ndarray:
    """Product of every ``width`` factors in a row: of what is left of one block and the head of the next, so the width costs nothing."""
    n = len(factors) - width + 1
    if n < 1:
        return np.zeros(0)
    blocks = np.concatenate([factors, np.ones(-len(factors) % width)]).reshape(-1, width)
    head, rest = np.cumprod(blocks, 1).ravel(), np.cumprod(blocks[:, ::-1], 1)[:, ::-1].ravel()
    first = np.arange(n)
    return np.where(first % width == 0, 1.0, rest[first]) * head[first + width - 1]


def path_figures(r: np.ndarray, share: float, run: int) -> tuple:
    """n, mean, sd, skew, kurt, cut, shortfall, drawdown, worst run's return and start of a series of returns.

    Figures that a series is too short or too still for are None. The running peak
    starts at the first point of the curve.
    """
    n = len(r)
    if not n:
        return (0, *[None] * 9)
    mean = float(r.mean())
    sd = float(r.std(ddof=1)) if n > 1 else None
    z = (r - mean) / sd if sd is not None and sd >= TINY_SD else None
    skew, kurt = (float((z**3).mean()), float((z**4).mean())) if z is not None else (None, None)
    a, b, of_a, of_b = between(n, share)
    low, high = np.partition(r, [a, b])[[a, b]]
    cut = float(low if a == b or low == high else of_a * low + of_b * high)
    beyond = r[r <= cut]
    shortfall = -float(beyond.mean()) if len(beyond) else -cut
    curve = np.cumprod(1 + r)
    peak = np.maximum.accumulate(curve)
    fall = float(np.max(np.divide(peak - curve, peak, out=np.zeros(n), where=peak != 0)))
    runs = window_products(1 + r, run) - 1
    worst = int(runs.argmin()) if len(runs) else None
    return n, mean, sd, skew, kurt, cut, shortfall, fall, None if worst is None else float(runs[worst]), worst


def covariances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common days, sample covariance) of each row of ``a`` with each of ``b``; NaN marks a day without a value."""
    has_a, has_b = ~np.isnan(a), ~np.isnan(b)
    # a constant off each row spares digits and leaves the covariance as it is
    level = lambda x, has: np.where(has, x - np.divide(np.where(has, x, 0).sum(1), has.sum(1), out=np.zeros(len(x)), where=has.any(1))[:, None], 0)
    x, y = level(a, has_a), level(b, has_b)
    n = has_a.astype(float) @ has_b.T.astype(float)
    sums = (x @ has_b.T) * (has_a @ y.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        return n, np.where(n > 1, (x @ y.T - sums / n) / (n - 1), np.nan)
