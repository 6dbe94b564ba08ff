"""Samplers, Monte Carlo summaries, convergence checks, sample-size bounds and optimisers.

A sampler is a function of (generator, size).  Work is spread over chains or parts; each has its own
generator, seeded by its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Sampler = Callable[[np.random.Generator, int], np.ndarray]


def sampler(kind: str, *p: float) -> Sampler:
    """bernoulli p; poisson m; exponential m; uniform a b; normal m s; log_normal m s; pareto a scale; gamma k scale; triangular a mode b."""
    made: dict[str, Sampler] = {
        "bernoulli": lambda g, n: (g.random(n) < p[0]).astype(float),
        "poisson": lambda g, n: g.poisson(p[0], n).astype(float),
        "exponential": lambda g, n: g.exponential(p[0], n),
        "uniform": lambda g, n: g.uniform(p[0], p[1], n),
        "normal": lambda g, n: g.normal(p[0], p[1], n),
        "log_normal": lambda g, n: g.lognormal(p[0], p[1], n),
        "pareto": lambda g, n: (1 + g.pareto(p[0], n)) * p[1],
        "gamma": lambda g, n: g.gamma(p[0], p[1], n),
        "triangular": lambda g, n: g.triangular(p[0], p[1], p[2], n),
    }
    return made[kind]


def histogram_sampler(low: float, width: float, counts: list[float], smooth: bool = True) -> Sampler:
    """Bins by their counts; uniform within a bin, or its middle."""
    w = np.array(counts, float) / sum(counts)
    return lambda g, n: low + width * (g.choice(len(w), n, p=w) + (g.random(n) if smooth else 0.5))


def discrete_sampler(values: list, weights: list[float]) -> Sampler:
    w = np.array(weights, float) / sum(weights)
    return lambda g, n: np.array(values)[g.choice(len(w), n, p=w)]


def rejection_sampler(density: Callable[[np.ndarray], np.ndarray], low: float, high: float, top: float) -> Sampler:
    """From a density on [low, high] that stays below ``top``."""

    def draw(g, n):
        out = np.zeros(0)
        while len(out) < n:
            x = g.uniform(low, high, 2 * n)
            out = np.append(out, x[g.random(2 * n) * top < density(x)])
        return out[:n]

    return draw


def mixture_sampler(parts: list[Sampler], weights: list[float]) -> Sampler:
    def draw(g, n):
        k = g.choice(len(parts), n, p=np.array(weights) / sum(weights))
        return np.choose(k, [p(g, n) for p in parts])

    return draw


def ancestral_sampler(root: list[float], given: list[Sampler]) -> Sampler:
    """A class by its share, then a value by the class's law."""
    return mixture_sampler(given, root)


def metropolis(density: Callable[[float], float], start: float, step: float, burn: int = 100, skip: int = 1) -> Sampler:
    """Random walk with normal steps."""

    def draw(g, n):
        x, p, out = start, density(start), []
        for i in range(burn + n * skip):
            y = x + g.normal(0, step)
            q = density(y)
            if p <= 0 or g.random() < q / p:
                x, p = y, q
            if i >= burn and (i - burn) % skip == 0:
                out.append(x)
        return np.array(out[:n])

    return draw


def permutations(size: int) -> Sampler:
    return lambda g, n: np.array([g.permutation(size) for _ in range(n)])


def events(rate: float) -> Sampler:
    """Times of a Poisson process."""
    return lambda g, n: np.cumsum(g.exponential(1 / rate, n))


def spikes(base: Sampler, share: float, factor: float) -> Sampler:
    def draw(g, n):
        x = base(g, n)
        return np.where(g.random(n) < share, x * factor, x)

    return draw


def simulate(spark, samplers: dict[str, Sampler], f: Callable[..., np.ndarray], n: int, parts: int = 8, seed: int = 1) -> DataFrame:
    """value = f(**draws) for n draws of all samplers."""

    def run(it):
        for b in it:
            for part, size in zip(b.id, b.k):
                g = np.random.default_rng([seed, int(part)])
                yield pd.DataFrame({"value": np.asarray(f(**{k: s(g, int(size)) for k, s in samplers.items()}), float)})

    return spark.range(parts).repartition(parts).withColumn("k", F.lit(-(-n // parts))).mapInPandas(run, "value double")


def summary(values: DataFrame, tail: float = 0.05) -> DataFrame:
    """n, sum, mean, sd, median, and the values that cut off each tail."""
    return values.agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", 0.5).alias("median"), F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))


def geweke(x: np.ndarray, first: float = 0.1, last: float = 0.5) -> float:
    """z of the means of a chain's first and last parts."""
    a, b = x[: int(first * len(x))], x[len(x) - int(last * len(x)) :]
    return float((a.mean() - b.mean()) / math.sqrt(a.var() / len(a) + b.var() / len(b)))


def raftery_lewis(x: np.ndarray, q: float = 0.025, within: float = 0.005, confidence: float = 0.95, eps: float = 0.001) -> tuple[int, int]:
    """Burn-in and run length at which quantile q is known within a bound, by a two-state chain."""
    from statistics import NormalDist

    z = (x <= np.quantile(x, q)).astype(int)
    up = ((z[:-1] == 0) & (z[1:] == 1)).sum() / max(1, (z[:-1] == 0).sum())
    down = ((z[:-1] == 1) & (z[1:] == 0)).sum() / max(1, (z[:-1] == 1).sum())
    up, down = max(up, 1e-9), max(down, 1e-9)
    rest = abs(1 - up - down)
    burn = 0 if rest < 1e-12 else math.ceil(math.log(eps * (up + down) / max(up, down)) / math.log(rest)) if rest < 1 else len(x)
    s = NormalDist().inv_cdf((1 + confidence) / 2)
    return int(max(0, burn)), int(math.ceil((2 - up - down) * up * down / (up + down) ** 3 * (s / within) ** 2))


def sample_bound(hypotheses: float, error: float, confidence: float) -> int:
    """Examples that PAC learning asks for: (ln H + ln 1/d) / e."""
    return math.ceil((math.log(hypotheses) + math.log(1 / (1 - confidence))) / error)


def conjunctions(values: list[int]) -> float:
    """Conjunctions of at most one value of each attribute."""
    return float(np.prod([v + 1 for v in values]))


def disjunctions(values: list[int], terms: int) -> float:
    """Disjunctions of so many conjunctions."""
    return float(conjunctions(values) ** terms)


def step(g: np.random.Generator, kind: str, size: float) -> float:
    """constant, uniform or gaussian step."""
    return {"constant": size, "uniform": g.uniform(0, size), "gaussian": abs(g.normal(0, size))}[kind]


def evolve(spark, cost, start, mutate, islands: int = 8, population: int = 10, generations: int = 30, seed: int = 1) -> DataFrame:
    """Evolution without crossover: the better half stays, and each of it has a mutant child; one row an island."""

    def run(it):
        for b in it:
            out = []
            for i in b.id:
                g = np.random.default_rng([seed, int(i)])
                pop = sorted(((cost(x), k, x) for k, x in enumerate(start(g) for _ in range(population))), key=lambda t: t[:2])
                for gen in range(generations):
                    half = pop[: max(1, population // 2)]
                    kids = [mutate(g, x) for _, _, x in half]
                    pop = sorted([*half, *((cost(y), population + gen * population + k, y) for k, y in enumerate(kids))], key=lambda t: t[:2])[:population]
                out.append((int(i), float(pop[0][0]), str(np.round(pop[0][2], 6).tolist())))
            yield pd.DataFrame(out, columns=["island", "cost", "solution"])

    return spark.range(islands).repartition(islands).mapInPandas(run, "island long, cost double, solution string")


def model_search(cost: Callable[[float], float], low: float, high: float, rounds: int = 15, width: float | None = None, seed: int = 1) -> tuple[float, float]:
    """Least cost on an interval by a Gaussian process and its lower confidence bound; one cost a round."""
    g = np.random.default_rng(seed)
    w = width or (high - low) / 5
    x = np.array([low, (low + high) / 2, high])
    y = np.array([cost(float(v)) for v in x])
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2) / (2 * w * w))
    for _ in range(rounds):
        sd = y.std() or 1.0
        at = g.uniform(low, high, 256)
        inv = np.linalg.inv(kernel(x, x) + 1e-6 * np.eye(len(x)))
        k = kernel(at, x)
        mean = k @ inv @ ((y - y.mean()) / sd)
        var = np.maximum(0.0, 1 - np.einsum("ij,jk,ik->i", k, inv, k))
        nxt = float(at[np.argmin(mean - 1.96 * np.sqrt(var))])
        x, y = np.append(x, nxt), np.append(y, cost(nxt))
    return float(x[np.argmin(y)]), float(y.min())


def temperature_for(costs: list[float], accept: float = 0.8) -> float:
    """Starting temperature at which the mean rise between neighbouring costs is accepted with a probability."""
    up = [b - a for a, b in zip(costs, costs[1:]) if b > a]
    return float(-np.mean(up) / math.log(accept)) if up else 1.0
