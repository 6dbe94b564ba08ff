from pyspark.sql import functions as F

from ..operators import simulate as s
from ..operators.contingency import rounded
from . import query


def _sum(a, b):
    return a + b


@query()
def simulate_sum(read):
    """Sum of a normal and a triangular draw."""
    v = s.simulate(read.spark, {"a": s.sampler("normal", 10.0, 2.0), "b": s.sampler("triangular", 0.0, 1.0, 4.0)}, _sum, 40_000)
    return rounded(s.summary(v))


@query()
def sampler_means(read):
    kinds = {"bernoulli": (0.3,), "poisson": (4.0,), "exponential": (2.0,), "uniform": (1.0, 3.0), "normal": (5.0, 1.0), "log_normal": (0.0, 0.5), "pareto": (3.0, 1.0), "gamma": (2.0, 1.5), "triangular": (0.0, 1.0, 2.0)}
    out = None
    for k, p in kinds.items():
        d = s.simulate(read.spark, {"x": s.sampler(k, *p)}, lambda x: x, 4_000, 2).agg(F.lit(k).alias("kind"), F.round(F.avg("value"), 6).alias("mean"))
        out = d if out is None else out.unionByName(d)
    return out


@query()
def metropolis(read):
    import math

    v = s.simulate(read.spark, {"x": s.metropolis(lambda x: math.exp(-x * x / 2), 0.0, 1.0)}, lambda x: x, 8_000, 4)
    return rounded(s.summary(v))


@query()
def evolve(read):
    return rounded(s.evolve(read.spark, lambda x: float(((x - 1) ** 2).sum()), lambda g: g.uniform(-5, 5, 3), lambda g, x: x + g.normal(0, 0.3, 3)))


@query()
def sample_bounds(read):
    rows = [("conjunctions", s.sample_bound(s.conjunctions([3, 4, 5]), 0.1, 0.95)), ("disjunctions", s.sample_bound(s.disjunctions([3, 4], 2), 0.1, 0.95))]
    return read.spark.createDataFrame(rows, "space string, examples long")
