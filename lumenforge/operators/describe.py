"""Descriptive statistics: one pass of partial aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, running


def num_stats(df: DataFrame, col: str) -> DataFrame:
    x = F.col(col)
    m = df.agg(F.avg(x).alias("m")).crossJoin(F.broadcast(quantiles(df, col, {"md": 0.5})))
    d = df.crossJoin(F.broadcast(m))  # one row
    mad = quantiles(d.select(F.abs(x - F.col("md")).alias("d")), "d", {"mad": 0.5}).select((F.col("mad") * 1.4826).alias("mad"))
    z = x - F.col("m")
    k = lambda p: F.avg(F.pow(z, F.lit(p)))
    out = d.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.first("m").alias("mean"), F.first("md").alias("median"), F.sqrt(k(2.0)).alias("std_pop"), (k(3.0) / F.pow(k(2.0), F.lit(1.5))).alias("skewness"), (k(4.0) / F.pow(k(2.0), F.lit(2.0)) - 3).alias("kurtosis"))
    out = out.crossJoin(F.broadcast(mad))
    return out.select("n", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def extremes(df: DataFrame, col: str, key: str, n: int) -> DataFrame:
    """The n least and greatest values; top-k on each partition first."""
    lo = df.select(key, col).orderBy(col, key).limit(n).withColumn("side", F.lit("low"))
    hi = df.select(key, col).orderBy(F.desc(col), key).limit(n).withColumn("side", F.lit("high"))
    return lo.unionByName(hi)


def cat_stats(df: DataFrame, col: str) -> DataFrame:
    c = df.groupBy(col).count()
    t = c.agg(F.sum("count").alias("n"), F.count("*").alias("n_unique"), F.max(F.struct("count", F.col(col).alias("v"))).alias("top"))
    p = F.col("count") / F.col("n")
    e = c.crossJoin(F.broadcast(t.select("n"))).agg(F.sum(-p * F.log(p)).alias("entropy"))
    return t.crossJoin(e).select("n", "n_unique", F.col("top.v").alias("mode"), F.col("top.count").alias("mode_count"), F.round("entropy", 6).alias("entropy"))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    one = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return one.unpivot("n", cols, "column", "nulls").select("column", "nulls", F.round(F.col("nulls") / F.col("n"), 6).alias("fraction"))


def type_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """binary, integer, float, categorical or mixed, by the values as text."""
    s = lambda c: F.trim(F.col(c).cast("string"))
    one = df.agg(*(F.struct(F.count(c).alias("n"), F.count_if(s(c).isin("0", "1")).alias("b"), F.count_if(s(c).rlike(r"^-?\d+$")).alias("i"), F.count_if(s(c).rlike(r"^-?\d+(\.\d+)?(E-?\d+)?$")).alias("f")).alias(c) for c in cols)).select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in cols))).alias("x")).select("x.column", "x.s.*")
    n = F.col("n")
    return one.select("column", F.when(F.col("b") == n, "binary").when(F.col("i") == n, "integer").when(F.col("f") == n, "float").when(F.col("f") == 0, "categorical").otherwise("mixed").alias("type"))


def histogram(df: DataFrame, col: str, bins: int, padded: bool = True) -> DataFrame:
    """Relative frequencies; padded widens the range by half a bin on each side."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n"))
    half = (F.col("hi") - F.col("lo")) / (2 * (bins - 1)) if padded else F.lit(0.0)
    r = r.select((F.col("lo") - half).alias("lo"), ((F.col("hi") - F.col("lo") + 2 * half) / bins).alias("width"), "n")
    b = F.least(F.floor((F.col(col) - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("int")
    return df.where(F.col(col).isNotNull()).crossJoin(F.broadcast(r)).groupBy(b.alias("bin")).agg(F.count("*").alias("count"), F.first("n").alias("n")).select("bin", "count", (F.col("count") / F.col("n")).alias("freq"))


def cumulative(hist: DataFrame) -> DataFrame:
    w = Window.orderBy("bin")  # a row for each bin
    return hist.select("bin", F.sum("count").over(w).alias("cum_count"))


def percentile_of(df: DataFrame, col: str, value: float) -> DataFrame:
    lt, le = F.count_if(F.col(col) < value), F.count_if(F.col(col) <= value)
    return df.agg(F.round(50.0 * (lt + le + F.when(le > lt, 1).otherwise(0)) / F.count(col), 6).alias("percentile"))


def char_counts(df: DataFrame, col: str) -> list[Column]:
    c = F.col(col)
    return [F.regexp_count(c, F.lit(p)).cast("long").alias(n) for n, p in (("alpha", "[A-Za-z]"), ("num", "[0-9]"), ("special", r"[^A-Za-z0-9\s]"))]


def stats_of(df: DataFrame, c: Column, prefix: str) -> list[Column]:
    return [F.round(F.avg(c), 6).alias(f"{prefix}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{prefix}_std"), F.max(c).alias(f"{prefix}_max"), F.min(c).alias(f"{prefix}_min")]


def monotonic(df: DataFrame, key: str, order: list[str], col: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    d = F.col(col) - F.lag(col).over(w)
    x = df.select(key, d.alias("d")).groupBy(key).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return x.select(key, F.coalesce(F.col("lo") >= 0, F.lit(True)).alias("increasing"), F.coalesce(F.col("hi") <= 0, F.lit(True)).alias("decreasing"))


def quantile_groups(df: DataFrame, col: str) -> DataFrame:
    return running(df.groupBy(col).count(), col, {"cum": F.col("count")})
