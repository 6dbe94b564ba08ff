import math
import random

from lumenforge.llm import mixing

DDL = "doc_id long, text string, source string, weight string, place string, block int"


def docs(spark, extra=()):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randrange(30))), r.choice(["a"] * 6 + ["b"] * 3 + ["c"]), "", "", 1) for i in range(600)]
    return spark.createDataFrame([*rows, *extra], DDL)


def test_budgets_are_met(spark):
    got = mixing.mixed(docs(spark), block=64).collect()
    assert len(got) == 600
    by = {}
    for x in got:
        by.setdefault(x.source, []).append(x)
    total = sum(x.n_tokens for x in got)
    shares = {}
    for s, rows in by.items():
        weight = rows[0].weight
        used = sum(x.n_tokens * x.copies for x in rows)
        assert abs(used - weight * total) <= 31  # to the document that crosses the budget
        shares[s] = weight
        # places are running sums over the source, each document at its own
        at = 0
        for x in sorted(rows, key=lambda x: (x.place, x.n_tokens)):
            assert x.place == at
            at += x.n_tokens
    h = -sum(p * math.log(p) for p in shares.values())
    assert abs(sum(shares.values()) - 1) < 1e-9 and h >= 0.98 * math.log(3) - 1e-6


def test_repetition_limit_raises_the_exponent(spark):
    low = {x.source: x.weight for x in mixing.mixed(docs(spark), entropy=1.0, repeats=1.5).collect()}
    got = mixing.mixed(docs(spark), entropy=1.0, repeats=1.5).collect()
    total = sum(x.n_tokens for x in got)
    tokens = {s: sum(x.n_tokens for x in got if x.source == s) for s in low}
    assert all(low[s] * total / tokens[s] <= 1.5 + 1e-6 for s in low)


def test_defined_cases(spark):
    extra = [(1000, None, None, "", "", 1), (1001, "", "empty", "", "", 1), (None, "x y", "a", "", "", 1), (5, "x y", "a", "", "", 1), (5, "x y", "a", "", "", 1), (1002, "w " * 100_000, "b", "", "", 1)]
    got = mixing.mixed(docs(spark, extra)).collect()
    assert len(got) == 606
    by = {x.source: x for x in got}
    assert by["empty"].weight == 0 and by["empty"].copies == 1 and by[None].n_tokens == 0
    assert mixing.mixed(spark.createDataFrame([], DDL)).count() == 0


def test_same_on_any_partitioning(spark):
    a = sorted(map(tuple, mixing.mixed(docs(spark)).collect()))
    b = sorted(map(tuple, mixing.mixed(docs(spark).repartition(7)).collect()))
    assert a == b
