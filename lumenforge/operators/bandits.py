"""Bandit scores from per-arm statistics, seeded choices, resampling and simulation."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arm_stats(df: DataFrame, arm: str, reward: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), arm).agg(F.count("*").alias("n"), F.avg(reward).alias("mean"), F.var_pop(reward).alias("var"))


def ucb1(stats: DataFrame, scale: float = 1.0, tuned: bool = False) -> DataFrame:
    t = stats.crossJoin(F.broadcast(stats.agg(F.sum("n").alias("all_n"))))
    ln = F.log("all_n") / F.col("n")
    if tuned:
        v = F.col("var") / scale**2 + F.sqrt(2 * ln)
        return t.withColumn("score", F.col("mean") / scale + F.sqrt(ln * F.least(F.lit(0.25), v)))
    return t.withColumn("score", F.col("mean") / scale + F.sqrt(2 * ln))


def softmax(stats: DataFrame, temperature: float) -> DataFrame:
    e = F.exp(F.col("mean") / temperature)
    return stats.crossJoin(F.broadcast(stats.agg(F.sum(e).alias("Z")))).withColumn("p", e / F.col("Z"))


def hashed(seed: int, *key: Column) -> Column:
    """A number of 40 bits, the first of the MD5 of seed and key as text, so that any engine can repeat the choice."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 10), 16, 10).cast("long")


def uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) that depends on seed and key alone, not on partitioning."""
    return (hashed(seed, *key) + 0.5) / float(1 << 40)


def sample_classes(df: DataFrame, cls: str, key: str, seed: int = 1) -> DataFrame:
    """Under-samples the greater classes to the expected size of the least."""
    n = df.groupBy(cls).agg(F.count("*").alias("_n"))
    n = n.crossJoin(F.broadcast(n.agg(F.min("_n").alias("_m")))).select(cls, (F.col("_m") / F.col("_n")).alias("_p"))
    return df.join(F.broadcast(n), cls).where(uniform(seed, F.col(key)) < F.col("_p")).drop("_p")


def bag(df: DataFrame, key: str, rate: float, seed: int = 1) -> DataFrame:
    """Sampling with replacement: each row comes a Poisson number of times."""
    u, p, total, k = uniform(seed, F.col(key)), np.exp(-rate), 0.0, F.lit(0)
    for i in range(12):
        total += p
        k = k + (u > total).cast("int")
        p *= rate / (i + 1)
    return df.withColumn("_k", k).where("_k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")


def smote(neighbours: DataFrame, rows: DataFrame, key: str, cols: list[str], seed: int = 1) -> DataFrame:
    """A new row between each row and each of its neighbours of the same class."""
    x = neighbours.join(rows.alias("a"), F.col("src") == F.col(f"a.{key}")).join(rows.alias("b"), F.col("dst") == F.col(f"b.{key}"))
    g = uniform(seed, F.col("src"), F.col("dst"))
    return x.select("src", "dst", *((F.col(f"a.{c}") + g * (F.col(f"b.{c}") - F.col(f"a.{c}"))).alias(c) for c in cols))


def monte_carlo(spark, n: int, f, parts: int = 8, seed: int = 1) -> DataFrame:
    """f(rng, size) -> values, in as many tasks as parts."""

    def run(it):
        for b in it:
            for p, k in zip(b.id, b.k):
                yield pd.DataFrame({"value": f(np.random.default_rng([seed, int(p)]), int(k))})

    return spark.range(parts).repartition(parts).withColumn("k", F.lit(-(-n // parts))).mapInPandas(run, "value double")


def search(spark, cost, moves, start, restarts: int, steps: int, kind: str = "annealing", heat: float = 1.0, seed: int = 1, valid=None, tabu: int = 0, tries: int = 20) -> DataFrame:
    """Independent optimisers, one row each: annealing, hill climb or random search.

    valid: whether a solution is allowed; tabu: how many of the last solutions are not tried again.  A move that breaks
    one is drawn again, ``tries`` times at most, then not made.
    """

    def run(it):
        for b in it:
            out = []
            for i in b.id:
                rng = np.random.default_rng([seed, int(i)])
                x = next((y for y in (start(rng) for _ in range(1000)) if valid is None or valid(y)), None)
                if x is None:
                    raise ValueError("no valid start among a thousand")
                c, seen = cost(x), deque([tuple(map(float, x))], tabu or None) if tabu else ()
                best = (c, x)
                for k in range(steps):
                    y = next((y for y in (start(rng) if kind == "random" else moves(rng, x) for _ in range(tries)) if (valid is None or valid(y)) and (not tabu or tuple(map(float, y)) not in seen)), None)
                    if y is None:
                        continue
                    if tabu:
                        seen.append(tuple(map(float, y)))
                    d = cost(y)
                    t = heat * (1 - k / steps) + 1e-9
                    if d < c or kind == "annealing" and rng.random() < np.exp(min(0.0, (c - d) / t)):
                        x, c = y, d
                        if c < best[0]:
                            best = (c, x)
                out.append((int(i), float(best[0]), str(list(map(int, best[1])))))
            yield pd.DataFrame(out, columns=["optimizer", "cost", "solution"])

    return spark.range(restarts).repartition(min(restarts, 8)).mapInPandas(run, "optimizer long, cost double, solution string")


def genetic(spark, cost, size: int, genes: int, population: int, generations: int, islands: int = 4, seed: int = 1) -> DataFrame:
    """Genetic search over permutations on islands; tournament, order crossover, swap mutation."""

    def run(it):
        for b in it:
            out = []
            for i in b.id:
                rng = np.random.default_rng([seed, int(i)])
                pop = [rng.permutation(genes)[:size] for _ in range(population)]
                for _ in range(generations):
                    score = [cost(p) for p in pop]
                    new = [pop[int(np.argmin(score))]]
                    while len(new) < population:
                        a, b2 = (min(rng.integers(0, population, 3), key=lambda j: score[j]) for _ in range(2))
                        cut = int(rng.integers(1, size))
                        child = [*pop[a][:cut], *(g for g in pop[b2] if g not in set(pop[a][:cut].tolist()))][:size]
                        free = [g for g in range(genes) if g not in set(map(int, child))]
                        child = np.array([*child, *free[: size - len(child)]])
                        if rng.random() < 0.3:
                            j, k = rng.integers(0, size, 2)
                            child[[j, k]] = child[[k, j]]
                        new.append(child)
                    pop = new
                best = min(pop, key=cost)
                out.append((int(i), float(cost(best)), str(list(map(int, best)))))
            yield pd.DataFrame(out, columns=["optimizer", "cost", "solution"])

    return spark.range(islands).repartition(islands).mapInPandas(run, "optimizer long, cost double, solution string")


def rank_arms(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(score, 9)), "arm")))
