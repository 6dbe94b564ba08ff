"""Two-sample and normality statistics.

All work on counts of distinct values with running sums in value order (see ``ordered``), so
no task sorts a whole sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import average_ranks, quantiles, running, with_next


def ecdf(df: DataFrame, value: str, first: Column) -> DataFrame:
    """For each distinct value: counts a, b of the two samples and their running sums ca, cb."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    return running(c, "x", {"ca": F.col("a"), "cb": F.col("b")})


def with_sizes(e: DataFrame) -> DataFrame:
    return e.crossJoin(F.broadcast(e.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))))


def ks(df: DataFrame, value: str, first: Column, alpha: float = 0.05) -> DataFrame:
    """Greatest gap, critical value as documented (alpha is not halved), and whether it is exceeded."""
    e = with_sizes(ecdf(df, value, first))
    g = e.agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    crit = F.sqrt(F.lit(-0.5) * F.log(F.lit(alpha))) * F.sqrt((F.col("na") + F.col("nb")) / (F.col("na") * F.col("nb")))
    return g.select("ks", crit.alias("critical"), (F.col("ks") > crit).alias("drift"))


def wasserstein(df: DataFrame, value: str, first: Column) -> DataFrame:
    e = with_next(with_sizes(ecdf(df, value, first)), "x", "nx")
    return e.agg(F.sum(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb")) * (F.col("nx") - F.col("x"))).alias("wasserstein"))


def cramer_von_mises(df: DataFrame, value: str, first: Column) -> DataFrame:
    """T of the two-sample test: weighted squared gaps of the two distributions."""
    e = with_sizes(ecdf(df, value, first))
    n, m = F.col("na"), F.col("nb")
    gap = F.col("ca") / n - F.col("cb") / m
    return e.agg((F.first(n * m / ((n + m) * (n + m))) * F.sum((F.col("a") + F.col("b")) * gap * gap)).alias("cvm"))


def t_statistic(df: DataFrame, value: str, first: Column) -> DataFrame:
    g = df.agg(*(f(F.when(c, F.col(value))).alias(k + s) for s, c in (("a", first), ("b", ~first)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    na, nb = F.col("na"), F.col("nb")
    sp = ((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / (na + nb - 2)
    return g.select(((F.col("ma") - F.col("mb")) / F.sqrt(sp * (1 / na + 1 / nb))).alias("t"))


def rank_sums(df: DataFrame, value: str, group: Column) -> DataFrame:
    """g, n, rank sum, and the tie correction over all groups."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x"), group.alias("g")).agg(F.count("*").alias("k"))
    t = running(c.groupBy("x").agg(F.sum("k").alias("n")), "x", {"c": F.col("n")}).select(F.col("x").alias("y"), (F.col("c") - (F.col("n") - 1) / 2.0).alias("rank"), F.col("n").alias("ties"))
    n = t.agg(F.sum("ties").alias("total"), F.sum(F.pow("ties", 3) - F.col("ties")).alias("tie"))
    r = c.join(t, c["x"] == t["y"]).groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r"))
    return r.crossJoin(F.broadcast(n))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    r = rank_sums(df, value, first)
    x = r.agg(F.max(F.when(F.col("g"), F.col("n"))).alias("na"), F.max(F.when(~F.col("g"), F.col("n"))).alias("nb"), F.max(F.when(F.col("g"), F.col("r"))).alias("ra"), F.first("total").alias("n"), F.first("tie").alias("tie"))
    na, nb, n = F.col("na"), F.col("nb"), F.col("n")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("tie") / (n * (n - 1))))
    return x.select(u.alias("u"), ((u - na * nb / 2) / sd).alias("z"))


def kruskal(df: DataFrame, value: str, group: Column) -> DataFrame:
    r = rank_sums(df, value, group)
    n = F.first("total").cast("double")  # its cube passes the range of whole numbers
    h = F.lit(12.0) / (n * (n + 1)) * F.sum(F.col("r") * F.col("r") / F.col("n")) - 3 * (n + 1)
    return r.agg((h / (1 - F.first("tie") / (n * n * n - n))).alias("h"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    from .series import anova

    m = quantiles(df, value, {"_m": 0.5}, [group])
    return anova(df.join(m, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("z")), group, "z").withColumnRenamed("f", "w")


def bartlett(df: DataFrame, value: str, group: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.var_samp(value).alias("v"))
    f = F.col("n") - 1
    x = g.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(f * F.col("v")).alias("s"), F.sum(f * F.log("v")).alias("l"), F.sum(1 / f).alias("q"))
    d = F.col("total") - F.col("k")
    return x.select(((d * F.log(F.col("s") / d) - F.col("l")) / (1 + (F.col("q") - 1 / d) / (3 * (F.col("k") - 1)))).alias("bartlett"))


def median_test(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Chi-square (Yates) of counts above the grand median."""
    m = quantiles(df, value, {"m": 0.5})
    up = F.col(value) > F.col("m")
    t = df.crossJoin(F.broadcast(m)).agg(F.count_if(first & up).cast("double").alias("a"), F.count_if(~first & up).cast("double").alias("b"), F.count_if(first & ~up).cast("double").alias("c"), F.count_if(~first & ~up).cast("double").alias("d"))
    a, b, c, d = (F.col(x) for x in "abcd")
    n = a + b + c + d
    return t.select((n * F.pow(F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2), 2.0) / ((a + b) * (c + d) * (a + c) * (b + d))).alias("chi_square"))


def mood_scale(df: DataFrame, value: str, first: Column) -> DataFrame:
    """z of the squared deviations of the first sample's ranks from the middle."""
    c = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(first).alias("a"), F.count("*").alias("k"))
    r = running(c, "x", {"cum": F.col("k")}).withColumn("rank", F.col("cum") - (F.col("k") - 1) / 2.0)
    t = r.agg(F.sum("k").cast("double").alias("n"), F.sum("a").cast("double").alias("m"))
    n, m = F.col("n"), F.col("m")
    s = r.crossJoin(F.broadcast(t)).agg(F.sum(F.col("a") * F.pow(F.col("rank") - (n + 1) / 2, 2.0)).alias("s"), F.first("n").alias("n"), F.first("m").alias("m"))
    return s.select(((F.col("s") - m * (n * n - 1) / 12) / F.sqrt(m * (n - m) * (n + 1) * (n * n - 4) / 180)).alias("z"))


def ansari(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Sum over the first sample of min(rank, n + 1 - rank), average ranks."""
    c = df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(first).alias("a"), F.count("*").alias("k"))
    r = running(c, "x", {"cum": F.col("k")}).withColumn("rank", F.col("cum") - (F.col("k") - 1) / 2.0)
    n = r.agg(F.sum("k").alias("n"))
    return r.crossJoin(F.broadcast(n)).agg(F.sum(F.col("a") * F.least(F.col("rank"), F.col("n") + 1 - F.col("rank"))).alias("ab"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    d = df.select((F.col(a) - F.col(b)).alias("d")).where("d <> 0").select(F.abs("d").alias("m"), F.signum("d").alias("s"))
    r = average_ranks(d, "m", "r")
    p, n = F.sum(F.when(F.col("s") > 0, F.col("r")).otherwise(0)), F.sum(F.when(F.col("s") < 0, F.col("r")).otherwise(0))
    return r.agg(F.least(p, n).alias("w"), F.count("*").alias("n"))


def friedman(df: DataFrame, cols: list[str]) -> DataFrame:
    """Chi-square from ranks within rows (ties averaged, no correction)."""
    k = len(cols)
    rank = lambda c: sum(((F.col(o) < F.col(c)).cast("double") + 0.5 * (F.col(o) == F.col(c)).cast("double") for o in cols if o != c), F.lit(1.0))
    s = df.agg(F.count("*").alias("n"), *(F.sum(rank(c)).alias(f"r{i}") for i, c in enumerate(cols)))
    n = F.col("n")
    return s.select((F.lit(12.0) / (n * k * (k + 1)) * sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)), F.lit(0.0)) - 3 * n * (k + 1)).alias("chi_square"))


def jarque_bera(df: DataFrame, value: str) -> DataFrame:
    s, k = F.skewness(value), F.kurtosis(value)
    jb = F.count(value) / 6 * (s * s + k * k / 4)
    return df.agg(jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def anderson_normal(df: DataFrame, value: str) -> DataFrame:
    """Anderson-Darling statistic on values standardised by the sample deviation, from counts of values."""
    m = df.agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    c = running(df.groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("k")), "x", {"cum": F.col("k")}).crossJoin(F.broadcast(m))
    t = F.col("t")
    # Zelen and Severo's polynomial, absolute error below 7.5e-8
    c = c.withColumn("z", (F.col("x") - F.col("m")) / F.col("s")).withColumn("t", 1 / (1 + 0.2316419 * F.abs("z")))
    tail = F.exp(-F.col("z") * F.col("z") / 2) / 2.5066282746310002 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    cdf = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.when(F.col("z") >= 0, 1 - tail).otherwise(tail)))
    lo = F.col("cum") - F.col("k")  # sum of 2i-1 over the value's k places is cum^2 - lo^2
    up = F.col("cum") * F.col("cum") - lo * lo
    down = F.pow(F.col("n") - lo, 2.0) - F.pow(F.col("n") - F.col("cum"), 2.0)
    return c.withColumn("cdf", cdf).agg((-F.first("n") - F.sum(up * F.log("cdf") + down * F.log(1 - F.col("cdf"))) / F.first("n")).alias("a2"))


def zhang(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Zhang's Z_K and Z_A from the running counts of both samples (ties by their upper rank)."""
    e = with_sizes(ecdf(df, value, first))
    n = F.col("na") + F.col("nb")
    p = (F.col("ca") + F.col("cb") - 0.5) / n
    part = lambda c, m: _plogp((F.col(c) / F.col(m)), F.col(m), p)
    za = lambda c, m: _entropy(F.col(c) / F.col(m)) * F.col(m)
    w = (F.col("ca") + F.col("cb") - 0.5) * (n - (F.col("ca") + F.col("cb")) + 0.5)
    return e.agg(F.max(part("ca", "na") + part("cb", "nb")).alias("zk"), F.sum(-(za("ca", "na") + za("cb", "nb")) / w * (F.col("a") + F.col("b")) * -1).alias("za"))


def _xlog(x: Column, y: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(x * F.log(x / y))


def _plogp(f: Column, m: Column, p: Column) -> Column:
    return m * (_xlog(f, p) + _xlog(1 - f, 1 - p))


def _entropy(f: Column) -> Column:
    return _xlog(f, F.lit(1.0)) + _xlog(1 - f, F.lit(1.0))
