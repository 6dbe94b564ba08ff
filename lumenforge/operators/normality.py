"""Tests of shape, and more two-sample tests, from moments or from counts of distinct values."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import chi2_sf, f_sf, t_sf2
from .ordered import quantiles, running, with_next
from .twosample import ecdf, with_sizes


def skew_z(skew: Column, n: Column) -> Column:
    """D'Agostino's z of population skewness."""
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    a = F.sqrt(2 / (w2 - 1))
    return 1 / F.sqrt(F.log(F.sqrt(w2))) * F.log(y / a + F.sqrt(y / a * (y / a) + 1))


def kurtosis_z(kurt: Column, n: Column) -> Column:
    """Anscombe and Glynn's z of population excess kurtosis."""
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - mean) / F.sqrt(var)
    s = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / s * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    c = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))
    return (1 - 2 / (9 * a) - c) / F.sqrt(2 / (9 * a))


def dagostino(df: DataFrame, value: str) -> DataFrame:
    """z of skewness and of kurtosis, their sum of squares and its p (chi-square with 2 degrees)."""
    m = df.agg(F.skewness(value).alias("s"), F.kurtosis(value).alias("k"), F.count(value).cast("double").alias("n"))
    z = m.select(skew_z(F.col("s"), F.col("n")).alias("skew_z"), kurtosis_z(F.col("k"), F.col("n")).alias("kurtosis_z"))
    k2 = F.col("skew_z") * F.col("skew_z") + F.col("kurtosis_z") * F.col("kurtosis_z")
    return z.select("skew_z", "kurtosis_z", k2.alias("k2"), F.exp(-k2 / 2).alias("p"))


def anderson(df: DataFrame, value: str, law: str) -> DataFrame:
    """Anderson-Darling statistic against expon, logistic, gumbel_r or gumbel_l.

    The exponential law has the sample mean; the others the sample's mean and deviation (moment fits).
    """
    m = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    c = running(df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k")), "x", {"cum": F.col("k")}).crossJoin(F.broadcast(m))
    x, mean, sd = F.col("x"), F.col("m"), F.col("s")
    scale = sd * math.sqrt(6) / math.pi
    cdf = {
        "expon": 1 - F.exp(-x / mean),
        "logistic": 1 / (1 + F.exp(-(x - mean) / (sd * math.sqrt(3) / math.pi))),
        "gumbel_r": F.exp(-F.exp(-(x - (mean - 0.5772156649015329 * scale)) / scale)),
        "gumbel_l": 1 - F.exp(-F.exp((x - (mean + 0.5772156649015329 * scale)) / scale)),
    }[law]
    cdf = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), cdf))
    lo = F.col("cum") - F.col("k")
    up = F.col("cum") * F.col("cum") - lo * lo
    down = F.pow(F.col("n") - lo, 2.0) - F.pow(F.col("n") - F.col("cum"), 2.0)
    return c.withColumn("cdf", cdf).agg((-F.first("n") - F.sum(up * F.log("cdf") + down * F.log(1 - F.col("cdf"))) / F.first("n")).alias("a2"))


def anderson_two(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Two-sample Anderson-Darling statistic with mid-ranks, and its standardised form."""
    e = with_sizes(ecdf(df, value, first))
    n = (F.col("na") + F.col("nb")).cast("double")
    k = F.col("a") + F.col("b")
    below = F.col("ca") + F.col("cb") - k / 2

    def part(c: str, f: str, size: str) -> Column:
        m = F.col(c) - F.col(f) / 2
        return F.pow(n * m - below * F.col(size), 2.0) / F.col(size)

    term = k / n * (part("ca", "a", "na") + part("cb", "b", "nb")) / (below * (n - below) - n * k / 4)
    one = e.agg(F.sum(term).alias("s"), F.first("na").alias("na"), F.first("nb").alias("nb")).first()  # one row
    na, nb = one["na"], one["nb"]
    size = na + nb
    a2 = one["s"] * (size - 1) / size
    return df.sparkSession.createDataFrame([(float(a2), float((a2 - 1) / _ad_sigma(na, nb)))], "a2 double, standard double")


def _ad_sigma(na: int, nb: int) -> float:
    n, k = na + nb, 2
    h_all = 1 / na + 1 / nb
    if n <= 1_000_000:
        inv = 1 / np.arange(1, n)
        h = float(inv.sum())
        tail = np.cumsum(inv[::-1])[::-1]  # tail[i]: sum of 1 / j for j > i
        g = float((tail[1:] * inv[::-1][: n - 2]).sum())
    else:
        h, g = math.log(n - 1) + 0.5772156649015329 + 0.5 / (n - 1), math.pi**2 / 6
    a = (4 * g - 6) * (k - 1) + (10 - 6 * g) * h_all
    b = (2 * g - 4) * k * k + 8 * h * k + (2 * g - 14 * h - 4) * h_all - 8 * h + 4 * g - 6
    c = (6 * h + 2 * g - 2) * k * k + (4 * h - 4 * g + 6) * k + (2 * h - 6) * h_all + 4 * h
    d = (2 * h + 6) * k * k - 4 * h * k
    return math.sqrt((a * n**3 + b * n**2 + c * n + d) / ((n - 1.0) * (n - 2) * (n - 3)))


def normal_quantile(p: Column) -> Column:
    """Acklam's rational approximation, relative error below 1.2e-9."""
    # coefficients: fixed values
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def horner(k, x, last=None):
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out if last is None else out * x + last

    q = p - 0.5
    r = q * q
    mid = horner(a, r) * q / horner(b, r, 1.0)
    tail = lambda x: horner(c, F.sqrt(-2 * F.log(x))) / horner(d, F.sqrt(-2 * F.log(x)), 1.0)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(mid)


def fligner(df: DataFrame, value: str, group: str) -> DataFrame:
    """Fligner-Killeen: normal scores of ranks of distances from the group's median."""
    m = quantiles(df, value, {"_m": 0.5}, [group])
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_x")).agg(F.count("*").alias("_k"))
    d = counts.join(m, group).groupBy(F.col(group).alias("g"), F.abs(F.col("_x") - F.col("_m")).alias("d")).agg(F.sum("_k").alias("k"))
    r = running(d.groupBy("d").agg(F.sum("k").alias("ties")), "d", {"c": F.col("ties")}).select(F.col("d").alias("_d"), (F.col("c") - (F.col("ties") - 1) / 2.0).alias("r"))
    n = d.agg(F.sum("k").alias("n"))
    s = d.join(r, F.col("d") == F.col("_d")).crossJoin(F.broadcast(n)).select("g", "k", "n", normal_quantile(F.col("r") / (2 * (F.col("n") + 1)) + 0.5).alias("a"))
    t = s.agg((F.sum(F.col("k") * F.col("a")) / F.first("n")).alias("mean"), F.first("n").alias("total"))
    s = s.crossJoin(F.broadcast(t))
    gap = F.col("a") - F.col("mean")
    g = s.groupBy("g").agg(F.sum("k").alias("size"), F.sum(F.col("k") * gap).alias("off"), F.sum(F.col("k") * gap * gap).alias("square"), F.first("total").alias("total"))
    return g.agg((F.sum(F.col("off") * F.col("off") / F.col("size")) / (F.sum("square") / (F.first("total") - 1))).alias("fligner"))


def epps_singleton(df: DataFrame, value: str, first: Column, at: tuple[float, ...] = (0.4, 0.8)) -> DataFrame:
    """Difference of the empirical characteristic functions at points scaled by half the pooled interquartile range."""
    q = quantiles(df, value, {"low": 0.25, "high": 0.75}).first()
    sigma = (q["high"] - q["low"]) / 2
    g = [f(F.col(value) * (t / sigma)) for f in (F.cos, F.sin) for t in at]
    k = len(g)
    x = df.where(F.col(value).isNotNull()).select(first.alias("first"), *(c.alias(f"g{i}") for i, c in enumerate(g)))
    sums = [F.avg(f"g{i}").alias(f"m{i}") for i in range(k)] + [F.covar_pop(f"g{i}", f"g{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    got = {r["first"]: r for r in x.groupBy("first").agg(F.count("*").alias("n"), *sums).collect()}  # two rows
    a, b = got[True], got[False]
    n = a["n"] + b["n"]
    cov = lambda r: np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    s = n / a["n"] * cov(a) + n / b["n"] * cov(b)
    gap = np.array([a[f"m{i}"] - b[f"m{i}"] for i in range(k)])
    w = float(n * gap @ np.linalg.pinv(s) @ gap)
    if max(a["n"], b["n"]) < 25:
        w /= 1 + n**-0.45 + 10.1 * (a["n"] ** -1.7 + b["n"] ** -1.7)
    return df.sparkSession.createDataFrame([(w, chi2_sf(w, int(np.linalg.matrix_rank(s))))], "w double, p double")


def log_gamma(x: Column) -> Column:
    """Of numbers from 0.5 on: Stirling's series eight steps further up."""
    y = x + 8
    up = sum((F.log(x + i) for i in range(8)), F.lit(0.0))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0))) - up


def zhang_c(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Zhang's Z_C: products of logs of the ranks within and across samples, tied values at their mean rank."""
    e = with_sizes(ecdf(df, value, first))
    n = F.col("na") + F.col("nb")
    rank = F.col("ca") + F.col("cb") - (F.col("a") + F.col("b") - 1) / 2
    across = F.log(n / (rank - 0.5) - 1)

    def within(count: str, cum: str, size: str) -> Column:
        low, high, m = F.col(cum) - F.col(count), F.col(cum), F.col(size)
        few = F.aggregate(F.sequence(low + 1, F.least(high, low + 64)), F.lit(0.0), lambda s, i: s + F.log(m / (i - 0.5) - 1))
        # many tied values: differences of log gammas in place of their terms
        many = log_gamma(m - low + 0.5) - log_gamma(m - high + 0.5) - log_gamma(high + 0.5) + log_gamma(low + 0.5)
        return F.when(F.col(count) > 64, many).when(F.col(count) > 0, few).otherwise(0.0)

    return e.agg((F.sum((within("a", "ca", "na") + within("b", "cb", "nb")) * across) / F.first(n)).alias("zc"))


def one_space_entropy(df: DataFrame, value: str) -> DataFrame:
    """Mean log gap between neighbouring distinct values, plus psi(n) - psi(1)."""
    d = with_next(df.select(F.col(value).cast("double").alias("x")).dropna().distinct(), "x", "nx")
    n = F.count("*").cast("double")
    psi = F.log(n) - 1 / (2 * n) - 1 / (12 * n * n)
    return d.agg((F.sum(F.log(F.col("nx") - F.col("x"))) / (n - 1) + psi + 0.5772156649015329).alias("entropy"))


def chi_square_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square (Yates' correction for two by two), degrees and p."""
    from .contingency import shares

    s = shares(df, a, b)
    d = s.agg(F.countDistinct("a").alias("ra"), F.countDistinct("b").alias("cb"))
    x = s.crossJoin(F.broadcast(d))
    e = F.col("r") * F.col("c") / F.col("t")
    gap = F.abs(F.col("n") - e)
    gap = F.when((F.col("ra") == 2) & (F.col("cb") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    # absent cells: their expectation counts as a whole, which the present ones of a row tell
    one = x.agg(F.sum(gap * gap / e).alias("s"), F.sum(e).alias("e"), F.first("t").alias("t"), F.first("ra").alias("ra"), F.first("cb").alias("cb")).first()
    stat, df_ = float(one["s"] + (one["t"] - one["e"])), (one["ra"] - 1) * (one["cb"] - 1)
    return df.sparkSession.createDataFrame([(stat, int(df_), chi2_sf(stat, df_) if df_ else 1.0)], "chi_square double, degrees int, p double")


def correlation_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's r with its two-sided p."""
    one = df.agg(F.corr(a, b).alias("r"), F.count("*").alias("n")).first()
    r, n = float(one["r"]), one["n"]
    t = r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))
    return df.sparkSession.createDataFrame([(r, t, t_sf2(t, n - 2))], "r double, t double, p double")


def anova_test(df: DataFrame, group: str, y: str) -> DataFrame:
    from .series import anova

    f = float(anova(df, group, y).first()["f"])
    one = df.where(F.col(y).isNotNull()).agg(F.count_distinct(group).alias("k"), F.count("*").alias("n")).first()
    return df.sparkSession.createDataFrame([(f, f_sf(f, one["k"] - 1, one["n"] - one["k"]))], "f double, p double")
