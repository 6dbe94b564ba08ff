"""Seeded sampling and shuffling.  Chance comes from a hash of the key, not from the partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bandits import uniform


def percent(df: DataFrame, key: str, share: float, seed: int = 1) -> DataFrame:
    return df.where(uniform(seed, F.col(key)) < share)


def weighted(df: DataFrame, key: str, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, the chance of the next in proportion to weight: greatest u^(1/w)."""
    return df.where(F.col(weight) > 0).withColumn("_k", F.log(uniform(seed, F.col(key))) / F.col(weight)).orderBy(F.desc("_k"), key).limit(n).drop("_k")


def replaced(df: DataFrame, key: str, rate: float, seed: int = 1) -> DataFrame:
    from .bandits import bag

    return bag(df, key, rate, seed)


def shuffled(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Adds ``place``, whose order is a random permutation."""
    return df.withColumn("place", uniform(seed, F.col(key)))


def block_shuffled(df: DataFrame, position: str, block: int, seed: int = 1) -> DataFrame:
    """Adds ``place``: blocks of consecutive positions in random order, order within a block kept."""
    b = F.floor(F.col(position) / block)
    return df.withColumn("place", F.struct(uniform(seed, b).alias("u"), b.alias("block"), F.col(position).alias("at")))


def bootstrap_extremes(df: DataFrame, key: str, col: str, draws: int, repeats: int, seed: int = 1) -> DataFrame:
    """Least and greatest value of ``repeats`` resamples of about ``draws`` rows each, one aggregation for all."""
    rate = df.agg((F.lit(float(draws)) / F.count("*")).alias("_r"))
    x = df.select(key, col).crossJoin(F.broadcast(rate)).select(key, col, "_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("sample"))
    taken = uniform(seed, F.col(key), F.col("sample")) < 1 - F.exp(-F.col("_r"))
    return x.where(taken).groupBy("sample").agg(F.min(col).alias("least"), F.max(col).alias("greatest"))


def batches(df: DataFrame, key: str, size: int, rate: float = 1.0, seed: int = 1) -> DataFrame:
    """Resampling with replacement within batches of consecutive keys: each row draws another of its batch."""
    b = F.floor(F.col(key) / size)
    x = df.withColumn("_b", b).withColumn("_i", F.col(key) % size)
    pick = x.select("_b", F.col(key).alias("slot"), F.floor(uniform(seed, F.col(key)) * size).alias("_i"))
    return pick.join(x, ["_b", "_i"]).drop("_b", "_i")
