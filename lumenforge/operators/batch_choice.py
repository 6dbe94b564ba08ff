"""Choices of a batch of items for every group at once, as windows over item states.

items: group, item, n (times tried), mean (reward).  Untried items always come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bandits import uniform


def ranked(items: DataFrame, score: Column, batch: int) -> DataFrame:
    """The first ``batch`` items of each group: untried ones, then by score, then by name."""
    w = Window.partitionBy("grp").orderBy(F.desc((F.col("n") == 0).cast("int")), F.desc(F.round(score, 9)), "item")
    return items.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= batch).select("grp", "item", "rank")


def deterministic(items: DataFrame, batch: int, scale: float = 1.0) -> DataFrame:
    """Mean over scale plus sqrt(2 ln N / n), N being the trials of the group."""
    total = F.sum("n").over(Window.partitionBy("grp"))
    x = items.withColumn("_t", total)
    score = F.col("mean") / scale + F.sqrt(2 * F.log(F.greatest("_t", F.lit(1))) / F.greatest("n", F.lit(1)))
    return ranked(x, score, batch)


def greedy(items: DataFrame, batch: int, round_number: int, probability: float = 0.5, reduction: str = "linear", constant: float = 1.0, seed: int = 1) -> DataFrame:
    """Each place of the batch explores with the round's probability; choices are unique."""
    from math import log

    k = {"none": 1.0, "linear": constant / round_number, "logLinear": constant * log(round_number + 1) / round_number}[reduction]
    p = min(1.0, probability * min(1.0, k))
    u = uniform(seed, F.lit(round_number), F.col("grp").cast("string"), F.col("item"))
    explore = uniform(seed + 1, F.lit(round_number), F.col("grp").cast("string"), F.col("item")) < p
    return ranked(items, F.when(explore, 1e9 + u).otherwise(F.col("mean")), batch)


def soft_max(items: DataFrame, batch: int, temperature: float, seed: int = 1) -> DataFrame:
    """Boltzmann sampling without replacement: the greatest of mean / T plus Gumbel noise."""
    u = uniform(seed, F.col("grp").cast("string"), F.col("item"))
    return ranked(items, F.col("mean") / temperature - F.log(-F.log(u)), batch)


def first_explore(items: DataFrame, batch: int, round_number: int, rounds: int, seed: int = 1) -> DataFrame:
    """Random choices for so many rounds, then the best."""
    u = uniform(seed, F.lit(round_number), F.col("grp").cast("string"), F.col("item"))
    return ranked(items, u if round_number <= rounds else F.col("mean"), batch)
