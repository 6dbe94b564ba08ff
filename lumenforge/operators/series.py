"""Correlation, regression and time series.  Series are per key, so windows are partitioned."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import discordant, running


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation and sample covariance of all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*(F.struct(F.corr(a, b).alias("corr"), F.covar_samp(a, b).alias("covar")).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("s")) for a, b in pairs))).alias("x")).select("x.a", "x.b", "x.s.corr", "x.s.covar")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks; no task holds the whole order."""
    d = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna().groupBy("a", "b").agg(F.count("*").alias("w"))
    for c in "ab":  # a row for each pair of values meets the ranks, a row for each value
        n = running(d.groupBy(c).agg(F.sum("w").alias("_n")), c, {"_c": F.col("_n")})
        d = d.join(n.select(F.col(c).alias(f"_{c}"), (F.col("_c") - (F.col("_n") - 1) / 2.0).alias(f"r{c}")), F.col(c) == F.col(f"_{c}"))
    mid = (d.agg(F.sum("w").alias("n")).first()["n"] or 0) / 2 + 0.5  # the mean rank
    x, y, w = F.col("ra") - mid, F.col("rb") - mid, F.col("w")
    return d.agg((F.sum(w * x * y) / F.sqrt(F.sum(w * x * x) * F.sum(w * y * y))).alias("rho"))


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b, without forming pairs."""
    x = discordant(df, a, b)
    total = F.col("n") * (F.col("n") - 1) / 2
    agree = total - F.col("tied_a") - F.col("tied_b") + F.col("tied_both") - 2 * F.col("discordant")
    return x.select((agree / F.sqrt((total - F.col("tied_a")) * (total - F.col("tied_b")))).alias("tau"))


def pair_slopes(s: DataFrame) -> DataFrame:
    """Slopes between all pairs of points of each series (k, i, x): quadratic in a series' length, as its definition asks."""
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.i") != F.col("b.i"))).select("a.k", "a.i", F.col("b.i").alias("j"), ((F.col("b.x") - F.col("a.x")) / (F.col("b.i") - F.col("a.i"))).alias("slope"))


def theil_sen(s: DataFrame) -> DataFrame:
    return pair_slopes(s).where("i < j").groupBy("k").agg(F.median("slope").alias("slope"))


def siegel(s: DataFrame) -> DataFrame:
    """Median over points of the median slope to all other points.

    A series (k, i, x) meets in one task, which holds its points and a block of slopes; slopes are not shuffled.
    """

    def run(table):
        i, x = (table.column(c).to_numpy().astype(float) for c in ("i", "x"))
        i, x = i[~np.isnan(x) & ~np.isnan(i)], x[~np.isnan(x) & ~np.isnan(i)]
        key, out, step = table.column("k"), [], max(1, (1 << 21) // max(1, len(i)))
        for at in range(0, len(i) if key[0].is_valid else 0, step):
            gap = i[None] - i[at : at + step, None]
            n = (gap != 0).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = np.where(gap != 0, (x[None] - x[at : at + step, None]) / gap, np.nan)
            slope.sort(axis=1)  # the points themselves come last
            slope, n = slope[n > 0], n[n > 0]
            low, high = (np.take_along_axis(slope, m[:, None], 1)[:, 0] for m in ((n - 1) // 2, n // 2))
            out.append(low + (high - low) * 0.5)
        out = np.concatenate(out) if out else np.empty(0)
        return pa.table({"k": key.slice(0, min(1, len(out))), "slope": pa.array([float(np.median(out))] if len(out) else [], pa.float64())})

    return s.select("k", "i", "x").groupBy("k").applyInArrow(run, f"k {dict(s.dtypes)['k']}, slope double")


def linear_fit(df: DataFrame, x: Column, y: Column, by: list[str] | None = None) -> DataFrame:
    """By centred sums: regr_* lose digits where x is far from 0."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def anova(df: DataFrame, group: str, y: str) -> DataFrame:
    g = df.groupBy(group).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    t = df.agg(F.avg(y).alias("gm"))
    x = g.crossJoin(F.broadcast(t)).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2.0)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return x.select((F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"))


def indexed(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias("k"), (F.row_number().over(w) - 1).alias("i"), F.col(value).alias("x"))


def difference(s: DataFrame, lag: int = 1) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i")
    return s.select("k", "i", (F.col("x") - F.lag("x", lag).over(w)).alias("d")).where("d is not null")


def detrend(s: DataFrame) -> DataFrame:
    f = linear_fit(s, F.col("i"), F.col("x"), ["k"])
    return s.join(f, "k").select("k", "i", (F.col("x") - (F.col("slope") * F.col("i") + F.col("intercept"))).alias("x"))


def moving_average_noise(s: DataFrame, size: int = 5) -> DataFrame:
    h = size // 2
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-h, h)
    x = s.select("k", F.col("x") - F.avg("x").over(w), F.count("*").over(w).alias("n")).toDF("k", "e", "n").where(F.col("n") == size)
    return x.groupBy("k").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("noise"))


def autocorrelation(s: DataFrame, lags: int) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i")
    m = Window.partitionBy("k")
    c = s.withColumn("c", F.col("x") - F.avg("x").over(m)).select("k", "c", *(F.lag("c", j).over(w).alias(f"l{j}") for j in range(1, lags + 1)))
    g = c.groupBy("k").agg(F.sum(F.col("c") * F.col("c")).alias("v"), *(F.sum(F.col("c") * F.col(f"l{j}")).alias(f"s{j}") for j in range(1, lags + 1)))
    return g.select("k", F.explode(F.array(*(F.struct(F.lit(j).alias("lag"), (F.col(f"s{j}") / F.col("v")).alias("acf")) for j in range(1, lags + 1)))).alias("e")).select("k", "e.lag", "e.acf")


def cross_correlation(s: DataFrame, lags: int) -> DataFrame:
    """Correlation of x at i with y at i - lag, for 0 .. lags; both are centred over the series (k, i, x, y)."""
    w = Window.partitionBy("k").orderBy("i")
    m = Window.partitionBy("k")
    c = s.select("k", "i", (F.col("x") - F.avg("x").over(m)).alias("x"), (F.col("y") - F.avg("y").over(m)).alias("y"))
    c = c.select("k", "x", "y", *(F.lag("y", j).over(w).alias(f"l{j}") for j in range(lags + 1)))
    g = c.groupBy("k").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))).alias("v"), *(F.sum(F.col("x") * F.col(f"l{j}")).alias(f"s{j}") for j in range(lags + 1)))
    return g.select("k", F.explode(F.array(*(F.struct(F.lit(j).alias("lag"), (F.col(f"s{j}") / F.col("v")).alias("ccf")) for j in range(lags + 1)))).alias("e")).select("k", "e.lag", "e.ccf")


def labelled(s: DataFrame, size: int) -> DataFrame:
    """``size`` consecutive values and the one after them."""
    w = Window.partitionBy("k").orderBy("i")
    x = s.select("k", "i", *(F.lead("x", j).over(w).alias(f"x{j}") for j in range(size)), F.lead("x", size).over(w).alias("y"))
    return x.where("y is not null")


def running_stats(s: DataFrame) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return s.select("k", "i", F.count("*").over(w).alias("n"), F.avg("x").over(w).alias("mean"), F.stddev_samp("x").over(w).alias("sd"))


def seasonal(s: DataFrame, period: int) -> DataFrame:
    """Centred moving average as trend, mean of what is left by phase as season."""
    h = period // 2
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-h, h)
    t = s.select("k", "i", "x", F.when(F.count("*").over(w) == 2 * h + 1, F.avg("x").over(w)).alias("trend"))
    c = t.where("trend is not null").groupBy("k", (F.col("i") % period).alias("phase")).agg(F.avg(F.col("x") - F.col("trend")).alias("season"))
    return t.withColumn("phase", F.col("i") % period).join(c, ["k", "phase"]).select("k", "i", "trend", "season", (F.col("x") - F.col("trend") - F.col("season")).alias("residue"))


def sliding(s: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("k").orderBy("i").rowsBetween(-(size - 1), 0)
    x = s.select("k", "i", F.count("*").over(w).alias("n"), F.avg("x").over(w).alias("mean"), F.stddev_pop("x").over(w).alias("sd"))
    return x.where(F.col("n") == size).drop("n")


def embedding(s: DataFrame, size: int, state: Column) -> DataFrame:
    """Relative frequency of tuples of consecutive states."""
    w = Window.partitionBy("k").orderBy("i")
    d = s.withColumn("s", state)
    t = d.select(*(F.lead("s", j).over(w).alias(f"s{j}") for j in range(size)))
    t = t.where(F.col(f"s{size - 1}").isNotNull()).groupBy(F.concat_ws(":", *(f"s{j}" for j in range(size))).alias("tuple")).agg(F.count("*").alias("n"))
    return t.crossJoin(F.broadcast(t.agg(F.sum("n").alias("t")))).select("tuple", "n", (F.col("n") / F.col("t")).alias("freq"))
