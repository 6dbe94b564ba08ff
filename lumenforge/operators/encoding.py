"""Encodings and scalings of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bandits import hashed


def dummies(df: DataFrame, col: str, values: list) -> DataFrame:
    return df.select("*", *((F.col(col) == v).cast("int").alias(f"{col}_{v}") for v in values)).drop(col)


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Value to code, in order of value; a row for each distinct value."""
    from .ordered import dense_index

    return dense_index(df.select(col).distinct(), col).withColumnRenamed("idx", "code")


def minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    r = df.agg(*(F.struct(F.min(c).alias("l"), F.max(c).alias("h")).alias(f"_r_{c}") for c in cols))
    return df.crossJoin(F.broadcast(r)).withColumns({c: (F.col(c) - F.col(f"_r_{c}.l")) / (F.col(f"_r_{c}.h") - F.col(f"_r_{c}.l")) for c in cols}).drop(*(f"_r_{c}" for c in cols))


def zscale(df: DataFrame, cols: list[str]) -> DataFrame:
    r = df.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_r_{c}") for c in cols))
    return df.crossJoin(F.broadcast(r)).withColumns({c: (F.col(c) - F.col(f"_r_{c}.m")) / F.col(f"_r_{c}.s") for c in cols}).drop(*(f"_r_{c}" for c in cols))


def linear_map(cols: list[str], matrix: list[list[float]]) -> list[Column]:
    return [sum((F.col(c) * w for c, w in zip(cols, row, strict=True)), F.lit(0.0)).alias(f"y{i}") for i, row in enumerate(matrix)]


def hash_vector(value: Column, size: int) -> list[Column]:
    """Signed slots of one hashed value."""
    slot, sign = F.pmod(hashed(1, value), F.lit(size)), F.when(F.pmod(hashed(2, value), F.lit(2)) == 1, 1).otherwise(-1)
    return [F.when(slot == i, sign).otherwise(0).alias(f"h{i}") for i in range(size)]


def step(x: Column, steps: list[tuple[float, float]]) -> Column:
    """Piecewise constant: steps are (upper end, value); the last value holds beyond."""
    out = F.lit(steps[-1][1])
    for up, v in reversed(steps[:-1]):
        out = F.when(x < up, v).otherwise(out)
    return out


def haversine(la1: Column, lo1: Column, la2: Column, lo2: Column, radius: float = 6371.0) -> Column:
    r = F.radians
    h = F.pow(F.sin((r(la2) - r(la1)) / 2), 2.0) + F.cos(r(la1)) * F.cos(r(la2)) * F.pow(F.sin((r(lo2) - r(lo1)) / 2), 2.0)
    return 2 * radius * F.asin(F.sqrt(h))


def distances(a: list[Column], b: list[Column]) -> list[Column]:
    d = [x - y for x, y in zip(a, b, strict=True)]
    tot = lambda xs: sum(xs, F.lit(0.0))
    na, nb = tot(x * x for x in a), tot(y * y for y in b)
    return [F.sqrt(tot(x * x for x in d)).alias("euclidean"), tot(F.abs(x) for x in d).alias("manhattan"), F.greatest(*(F.abs(x) for x in d)).alias("chebyshev"), (1 - tot(x * y for x, y in zip(a, b, strict=True)) / F.sqrt(na * nb)).alias("cosine")]
