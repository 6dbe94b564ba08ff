"""Every query that has SQL gives what DuckDB gives; the others run and give rows."""

import os

import pytest

import __spark_entry__ as entry
from lumenforge import catalog

from . import oracle

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DIR)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert oracle.difference(spark, con, DIR, catalog.QUERIES[name], catalog.ORACLE[name]) == ""


ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE))


@pytest.mark.parametrize("name", [n for n in ROWS_ONLY if not n.startswith(("classify_", "regress_", "learner_", "stream_"))])
def test_query_gives_the_same_rows_again(spark, name):
    """What SQL can't say: rows are there, numbers are finite, and a second run, dealt over other partitions, gives the same."""
    import math

    held = spark.conf.get("spark.sql.shuffle.partitions")
    got = catalog.QUERIES[name](spark, DIR).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = catalog.QUERIES[name](spark, DIR).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got and all(math.isfinite(v) for r in got for v in r if isinstance(v, float))
    if name not in LIBRARY:
        assert sorted(map(repr, got)) == sorted(map(repr, again))


#: fits of Spark's own library, whose sums follow the partitions
LIBRARY = {"gaussian_mixture", "lda_topics", "lda_terms", "word2vec", "document_vectors", "principal_components", "parameter_search"}


def test_draws_are_what_their_generators_give(spark):
    """Simulations and searches against loops over the same generators."""
    import numpy as np

    from lumenforge.plans import bandits

    at = [np.random.default_rng([1, p]) for p in range(8)]
    values = np.concatenate([(g.random(5000) ** 2 + g.random(5000) ** 2 <= 1) * 4.0 for g in at])
    got = catalog.QUERIES["monte_carlo"](spark, DIR).first()
    assert got.n == 40_000 and got.pi == round(float(values.mean()), 6)
    _, cost = bandits._tour()
    for name in ("annealing", "random_search", "genetic"):
        for r in catalog.QUERIES[name](spark, DIR).collect():
            x = np.array(eval(r.solution))
            assert sorted(x.tolist()) == list(range(12)) and r.cost == round(cost(x), 6)
    rng = np.random.default_rng([1, 3])
    best = min(cost(rng.permutation(12)) for _ in range(301))
    assert next(r.cost for r in catalog.QUERIES["random_search"](spark, DIR).collect() if r.optimizer == 3) == round(best, 6)
    law = {"bernoulli": 0.3, "poisson": 4, "exponential": 2, "uniform": 2, "normal": 5, "log_normal": float(np.exp(0.125)), "pareto": 1.5, "gamma": 3, "triangular": 1}
    for r in catalog.QUERIES["sampler_means"](spark, DIR).collect():
        assert abs(r["mean"] - law[r.kind]) < 0.1, r


def test_searches_keep_to_what_is_valid(spark):
    """No solution breaks the rule, and none of the last ones is tried again."""
    from lumenforge.operators import bandits as b

    seen = []
    even = lambda x: int(sum(x)) % 2 == 0
    got = b.search(spark, lambda x: float(sum(x)), lambda rng, x: [v + int(rng.integers(-1, 2)) for v in x], lambda rng: [int(rng.integers(0, 9)) for _ in range(3)], 3, 60, valid=even, tabu=5).collect()
    assert len(got) == 3 and all(sum(eval(r.solution)) % 2 == 0 and r.cost == sum(eval(r.solution)) for r in got) and not seen


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(0 < r["p"] <= 1 for r in rows)


def test_catalogue_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
