"""Operators that need one series as a whole: each group's values, in order, in one numpy call.

The work is spread over series; the longest series bounds a task's memory.  Statistics over a whole
column do not come here (see ``twosample``, ``normality``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_series(s: DataFrame, f: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """f(values) -> rows, for each series of s(k, i, x)."""
    names = [c.split()[0] for c in columns.split(", ")]
    kind = dict(s.dtypes)["k"]

    def run(key, pdf):
        x = pdf.sort_values("i")["x"].to_numpy(float)
        out = pd.DataFrame(f(x), columns=names)
        out.insert(0, "k", [key[0]] * len(out))
        return out

    return s.select("k", "i", "x").groupBy("k").applyInPandas(run, f"k {kind}, {columns}")


def partial_autocorrelation(x: np.ndarray, lags: int) -> list[tuple[int, float]]:
    """Durbin-Levinson over the autocorrelations."""
    c = x - x.mean()
    v = float(c @ c) or 1.0
    r = [1.0] + [float(c[j:] @ c[:-j]) / v for j in range(1, min(lags, len(x) - 1) + 1)]
    phi, out = np.zeros(0), []
    for k in range(1, len(r)):
        back = np.array(r[1:k])
        den = 1 - phi @ back if k > 1 else 1.0
        a = (r[k] - (phi @ back[::-1] if k > 1 else 0.0)) / (den if abs(den) > 1e-15 else 1e-15)
        phi = np.append(phi - a * phi[::-1], a)
        out.append((k, float(a)))
    return out


def hurst(x: np.ndarray, least: int = 8) -> float:
    """Slope of log rescaled range over log block size, blocks doubling from ``least``."""
    sizes, at = [], []
    n = least
    while n <= len(x) // 2 or n == least and len(x) >= least:
        b = x[: len(x) // n * n].reshape(-1, n)
        z = np.cumsum(b - b.mean(1, keepdims=True), axis=1)
        sd = b.std(1)
        rs = (z.max(1) - z.min(1))[sd > 0] / sd[sd > 0]
        if len(rs):
            sizes.append(math.log(n))
            at.append(math.log(rs.mean()))
        n *= 2
    return float(np.polyfit(sizes, at, 1)[0]) if len(sizes) > 1 else float("nan")


def approximate_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """phi(m) - phi(m + 1); r is in standard deviations.  Quadratic in the series' length, in blocks of rows."""
    tol = r * x.std()

    def phi(k: int) -> float:
        t = np.lib.stride_tricks.sliding_window_view(x, k)
        total = 0.0
        for at in range(0, len(t), 256):
            near = np.abs(t[at : at + 256, None, :] - t[None]).max(2) <= tol
            total += np.log(near.mean(1)).sum()
        return total / len(t)

    return float(phi(m) - phi(m + 1)) if len(x) > m + 1 else 0.0


def discord(x: np.ndarray, size: int) -> list[tuple[int, float]]:
    """The subsequence farthest from its nearest one that does not overlap it."""
    if len(x) < 2 * size:
        return []
    t = np.lib.stride_tricks.sliding_window_view(x, size)
    best = np.full(len(t), np.inf)
    at = np.arange(len(t))
    for lo in range(0, len(t), 256):
        d = np.sqrt(((t[lo : lo + 256, None, :] - t[None]) ** 2).sum(2))
        d[np.abs(at[lo : lo + 256, None] - at[None]) < size] = np.inf
        best[lo : lo + 256] = d.min(1)
    best[~np.isfinite(best)] = -1
    i = int(np.argmax(np.round(best, 9)))
    return [(i, float(best[i]))]


def spectrum(x: np.ndarray) -> list[tuple[int, float, float]]:
    """Frequency index, real and imaginary part of the discrete Fourier transform, lower half."""
    z = np.fft.rfft(x)
    return [(k, float(v.real), float(v.imag)) for k, v in enumerate(z)]


def adf(x: np.ndarray, lags: int = 1) -> list[tuple[float, float, float, float, bool]]:
    """t statistic of the unit root (constant, ``lags`` differences) and critical values at 1, 5 and 10 %."""
    d = np.diff(x)
    n = len(d) - lags
    if n <= lags + 3:
        return []
    cols = [np.ones(n), x[lags:-1], *(d[lags - j : len(d) - j] for j in range(1, lags + 1))]
    a, y = np.array(cols).T, d[lags:]
    xtx = np.linalg.pinv(a.T @ a)
    b = xtx @ a.T @ y
    e = y - a @ b
    t = float(b[1] / math.sqrt(e @ e / (n - a.shape[1]) * xtx[1, 1]))
    # MacKinnon's response surface for a constant: fixed values
    surface = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
    crit = [sum(c / n**i for i, c in enumerate(row)) for row in surface]
    return [(t, *crit, t < crit[1])]


def kpss(x: np.ndarray) -> list[tuple[float, float, int]]:
    """Level statistic, p from the table (held at its ends) and lags 12 (n / 100)^(1/4), rounded up."""
    n = len(x)
    e = x - x.mean()
    lags = min(n - 1, int(math.ceil(12 * (n / 100) ** 0.25)))
    s2 = float(e @ e) / n + 2 / n * sum((1 - j / (lags + 1)) * float(e[j:] @ e[:-j]) for j in range(1, lags + 1))
    stat = float((np.cumsum(e) ** 2).sum()) / n**2 / s2 if s2 else 0.0
    # critical values and their levels: fixed values
    p = float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))
    return [(stat, p, lags)]


def spirit(rows: np.ndarray, hidden: int = 1, forget: float = 0.96, low: float = 0.95, high: float = 0.98, most: int | None = None) -> list[tuple[int, int, float]]:
    """Incremental principal components of vectors in time order: time, hidden units, share of energy kept.

    Units come when the projections keep less than ``low`` of the energy, and go above ``high``.
    """
    dim = rows.shape[1]
    most = most or dim
    w, d = np.eye(dim), np.full(dim, 1e-3)
    k, energy, kept, out = hidden, 0.0, np.zeros(dim), []
    for t, v in enumerate(rows, 1):
        rest = v.astype(float)
        y = np.zeros(dim)
        for i in range(k):
            y[i] = w[i] @ rest
            d[i] = forget * d[i] + y[i] ** 2
            e = rest - y[i] * w[i]
            w[i] = w[i] + y[i] / d[i] * e
            rest = rest - y[i] * w[i]
        energy = (forget * (t - 1) * energy + float(v @ v)) / t
        kept[:k] = (forget * (t - 1) * kept[:k] + y[:k] ** 2) / t
        share = float(kept[:k].sum()) / energy if energy else 1.0
        out.append((t - 1, k, share))
        if share < low and k < most:
            k += 1
        elif k > 1 and float(kept[: k - 1].sum()) > high * energy:
            k -= 1
    return out


def principal_stream(df: DataFrame, key: str, order: str, cols: list[str], **options) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(k, pdf):
        out = pd.DataFrame(spirit(pdf.sort_values("o")[[f"c{i}" for i in range(len(cols))]].to_numpy(float), **options), columns=["t", "hidden", "energy"])
        out.insert(0, "k", [k[0]] * len(out))
        return out

    return df.select(F.col(key).alias("k"), F.col(order).alias("o"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(cols))).groupBy("k").applyInPandas(run, f"k {kind}, t long, hidden long, energy double")


def holt_winters(x: np.ndarray, period: int, ahead: int, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2) -> list[tuple[int, float]]:
    """Additive level, trend and season smoothed along the series, then carried on."""
    if len(x) < 2 * period:
        return [(h, float(x.mean())) for h in range(1, ahead + 1)] if len(x) else []
    level, trend = float(x[:period].mean()), float((x[period : 2 * period].mean() - x[:period].mean()) / period)
    season = [float(v) for v in x[:period] - level]
    for t, v in enumerate(x[period:], period):
        last, s = level, season[t % period]
        level = alpha * (v - s) + (1 - alpha) * (level + trend)
        trend = beta * (level - last) + (1 - beta) * trend
        season[t % period] = gamma * (v - level) + (1 - gamma) * s
    return [(h, level + h * trend + season[(len(x) + h - 1) % period]) for h in range(1, ahead + 1)]


def shapiro_wilk(x: np.ndarray) -> list[tuple[float, float]]:
    """W by Royston's approximation (4 to 5000 values), and p."""
    from statistics import NormalDist

    n, nd = len(x), NormalDist()
    if not 4 <= n <= 5000 or x.min() == x.max():
        return []
    y = np.sort(x)
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    # Royston's polynomials: fixed values
    c1 = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
    c2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
    a = m / math.sqrt(mm)
    last = a[-1] + poly(c1, u)
    if n > 5:
        next_ = a[-2] + poly(c2, u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * next_**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = next_, -next_
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    c = y - y.mean()
    w = float((a @ y) ** 2 / (c @ c))
    ln = math.log(n)
    if n <= 11:
        g = -2.273 + 0.459 * n
        z = (-math.log(max(1e-12, g - math.log(max(1e-300, 1 - w)))) - poly((0.5440, -0.39978, 0.025054, -6.714e-4), n)) / math.exp(poly((1.3822, -0.77857, 0.062767, -0.0020322), n))
    else:
        z = (math.log(max(1e-300, 1 - w)) - poly((-1.5861, -0.31082, -0.083751, 0.0038915), ln)) / math.exp(poly((-0.4803, -0.082676, 0.0030302), ln))
    return [(w, 0.5 * math.erfc(z / math.sqrt(2)))]
