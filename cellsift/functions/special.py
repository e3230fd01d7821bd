"""Numeric kernels in numpy: log-gamma, Student's t, local regression, linkage, p-value corrections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .columns import STIRLING


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log-gamma of positive numbers: the argument is shifted above 8, where Stirling's series is exact to rounding."""
    x = np.asarray(x, float)
    low = x < 8
    z = np.where(low, x + 8, x)
    lead = np.ones_like(x)
    for i in range(8):
        lead = lead * np.where(low, x + i, 1.0)
    inverse = 1 / (z * z)
    series = np.zeros_like(z)
    for c in reversed(STIRLING):
        series = series * inverse + c
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series / z - np.log(lead)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz' continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(inner) + q * np.log1p(-inner)) / p
    tiny = 1e-300
    safe = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(y), 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 400):
        even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        d, c = 1 / safe(1 + even * d), safe(1 + even / c)
        h = h * d * c
        odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d, c = 1 / safe(1 + odd * d), safe(1 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    value = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value of Student's t; 0 for an infinite t, NaN where t or dof are."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = incomplete_beta(np.where(dof > 0, dof, 1) / 2, 0.5, np.where(np.isfinite(t), dof / (dof + t * t), 0.5))
    p = np.where(np.isinf(t), 0.0, p)
    return np.where(np.isnan(t) | np.isnan(dof), np.nan, p)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    got = pd.Series(t_two_sided(t.to_numpy(float), dof.to_numpy(float)))
    return got.astype("Float64").mask(got.isna())


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic regression with tricube weights, fitted directly at every point.

    Of n points the floor(n * span + 1e-5) nearest count (all, with a wider kernel, for a span over 1).
    Neighbourhoods without width, or with too few distinct points for a parabola, use the highest degree they
    allow, down to the mean.
    """
    n = len(x)
    q = max(1, min(n, math.floor(n * span + 1e-5)))
    order = np.argsort(x, kind="stable")
    xs, ys, out, left = x[order], y[order], np.empty(n), 0
    for i in range(n):
        while left + q < n and xs[left + q] - xs[i] < xs[i] - xs[left]:
            left += 1
        h = max(xs[i] - xs[left], xs[left + q - 1] - xs[i]) * max(1.0, span) ** 1.0
        a, b = np.searchsorted(xs, [xs[i] - h, xs[i] + h], side="left")
        b = np.searchsorted(xs, xs[i] + h, side="right")
        u, v = xs[a:b] - xs[i], ys[a:b]
        if h <= 0:
            out[i] = v.mean()
            continue
        w = np.clip(1 - (np.abs(u) / h) ** 3, 0, None) ** 3
        degree = min(2, len(np.unique(u[w > 0])) - 1)
        s = np.sqrt(w)
        basis = np.vander(u / h, degree + 1, increasing=True)
        out[i] = np.linalg.lstsq(basis * s[:, None], v * s, rcond=None)[0][0]
    fitted = np.empty(n)
    fitted[order] = out
    return fitted


def complete_linkage(points: np.ndarray, k: int) -> np.ndarray:
    """Labels from 1 of k clusters by agglomeration with complete linkage, Euclidean; numbered by first member."""
    n = len(points)
    gaps = np.sqrt(np.maximum(((points[:, None, :] - points[None]) ** 2).sum(-1), 0)) if n <= 512 else pairwise(points)
    np.fill_diagonal(gaps, np.inf)
    member, alive = np.arange(n), np.ones(n, bool)
    nearest, at = gaps.argmin(1), gaps.min(1)
    for _ in range(max(0, n - k)):
        i = int(np.where(alive, at, np.inf).argmin())
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        row = np.maximum(gaps[i], gaps[j])
        row[i] = np.inf
        gaps[i], gaps[:, i] = row, row
        gaps[j], gaps[:, j] = np.inf, np.inf
        alive[j] = False
        member[member == j] = i
        for r in np.flatnonzero(alive & (np.isin(nearest, (i, j)) | (np.arange(n) == i))):
            nearest[r], at[r] = gaps[r].argmin(), gaps[r].min()
        better = alive & (gaps[:, i] < at)
        nearest[better], at[better] = i, gaps[better, i]
    names = {m: c for c, m in enumerate(dict.fromkeys(member.tolist()), 1)}
    return np.array([names[m] for m in member.tolist()])


def pairwise(points: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * points @ points.T, 0))


def hommel(p: np.ndarray) -> np.ndarray:
    """Hommel's adjustment by its definition: a p-value's is the largest Simes p-value of the sets that it is in.

    Of all sets of m p-values with a given one, that of it and the largest others has the largest. Simes p-values
    of the m largest, with their least or without it, fall as m grows: of the sets that have a p-value among
    their largest the smallest one counts, and of those where it stands for the least one, those where
    m times it meets the others' Simes p-value. Takes n log(n) steps.
    """
    order = np.argsort(p, kind="stable")
    s = p[order]
    n = len(s)
    if not n:
        return s
    sizes = np.arange(1, n + 1)
    others = np.append(np.inf, simes_of_others(s)[::-1])  # by m, without the least
    whole = np.minimum(sizes * s[::-1], others)
    out = np.maximum(s, np.maximum.accumulate(whole[::-1]))
    # by p-value, the largest m of sets where it stands for the least and m times it is no more than the others'
    most = np.arange(n - 1, -1, -1)
    low, high = np.zeros(n, np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        holds = (mid > 0) & (mid * s <= others[np.maximum(mid, 1) - 1])
        low, high = np.where(holds, mid, low), np.where(holds, high, np.maximum(mid - 1, low))
    out = np.maximum(out, low * s)
    more = low < most
    out[more] = np.maximum(out[more], others[low[more]])
    adjusted = np.empty(n)
    adjusted[order] = np.minimum(1, out)
    return adjusted


def simes_of_others(s: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """For each a from 0 to n - 2 the least of (n - a) * s[k] / (k - a + 1), k from a + 1 on; s ascends.

    The k of the least one doesn't fall as a grows, so that of every second a, of every fourth, ... bounds
    where those between are looked for.
    """
    n = len(s)
    out, best = np.full(n - 1, np.inf), np.zeros(n - 1, np.int64)
    step = 1 << max(0, (n - 1).bit_length() - 1)
    while step and n > 1:
        rows = np.arange(step - 1, n - 1, 2 * step)  # between those of the steps before
        before, after = rows - step, rows + step
        first = np.maximum(rows + 1, np.where(before >= 0, best[np.maximum(before, 0)], 0))
        last = np.where(after < n - 1, best[np.minimum(after, n - 2)], n - 1)
        last = np.maximum(last, first)
        ends = np.cumsum(last - first + 1)
        at = 0
        while at < len(rows):  # some rows at a time
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            size = (last - first + 1)[at:to]
            starts = np.cumsum(size) - size
            k = np.repeat(first[at:to] - starts, size) + np.arange(size.sum())
            a = np.repeat(rows[at:to], size)
            value = (n - a) * s[k] / (k - a + 1)
            least = np.minimum.reduceat(value, starts)
            hits = np.flatnonzero(value == np.repeat(least, size))
            of = np.searchsorted(starts, hits, side="right") - 1
            best[rows[at:to][of[::-1]]] = k[hits[::-1]]  # the first hit of each
            out[rows[at:to]] = least
            at = to
        step //= 2
    return out
