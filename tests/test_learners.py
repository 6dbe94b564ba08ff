import numpy as np
import pytest

from lumenforge.operators import batch_choice, learners, learning, routing, text_clean, text_models

P = {"a": 0.2, "b": 0.5, "c": 0.8}
OPTIONS = {"exponentialWeightExpert": {"experts": ({"a": 0.8, "b": 0.1, "c": 0.1}, {"a": 0.1, "b": 0.1, "c": 0.8})}, "softMax": {"temperature": 5.0, "least": 0.05}, "randomGreedy": {"constant": 20.0}, "rewardComparison": {"preference_rate": 0.4}}


@pytest.mark.parametrize("name", list(learners.LEARNERS))
def test_learner_finds_the_best_arm(name):
    g = np.random.default_rng(1)
    x = learners.create(name, list(P), **OPTIONS.get(name, {}))
    late = 0
    for i in range(1500):
        a = x.next_action()
        x.set_reward(a, float(g.random() < P[a]))
        late += a == "c" and i >= 750
        if i == 700:  # a state that is saved and read goes on alike
            x = learners.create(name, list(P), **OPTIONS.get(name, {})).load(x.state())
    assert late > 375


def test_unknown_option():
    with pytest.raises(ValueError):
        learners.create("softMax", ["a"], heat=1)


def test_rounds_carry_state(spark):
    state = spark.createDataFrame([(1, None), (2, None)], "grp long, state string")
    none = spark.createDataFrame([], "grp long, seq long, arm string, reward double")
    first = learners.batch_round(state, none, list(P), "upperConfidenceBoundOne", 3)
    got = {r.grp: r.actions for r in first.collect()}
    assert got == {1: "a,b,c", 2: "a,b,c"}
    pay = spark.createDataFrame([(1, 1, "a", 0.1), (1, 2, "b", 0.9), (1, 3, "c", 0.2)], "grp long, seq long, arm string, reward double")
    again = {r.grp: r.actions for r in learners.batch_round(first.drop("actions"), pay, list(P), "upperConfidenceBoundOne", 1).collect()}
    assert again[1] == "b"


def test_batch_choices(spark):
    d = spark.createDataFrame([(1, "x", 0, 0.0), (1, "y", 5, 0.9), (1, "z", 5, 0.1), (1, "w", 1, 0.5)], "grp int, item string, n long, mean double")
    pick = lambda x: [r.item for r in x.orderBy("rank").collect()]
    assert pick(batch_choice.deterministic(d, 2)) == ["x", "w"]
    assert pick(batch_choice.first_explore(d, 3, 9, 3)) == ["x", "y", "w"]
    assert pick(batch_choice.soft_max(d, 4, 0.001))[:2] == ["x", "y"]
    assert pick(batch_choice.greedy(d, 2, 10**6)) == ["x", "y"]


def test_groupings_and_points():
    g = routing.groupings(["a", "b", "c"], 3)
    assert len(g) == 4 and all(sorted(v for p in x for v in p) == ["a", "b", "c"] for x in g)
    assert routing.numeric_points(0, 40, 10, 3) == [(10,), (20,), (30,), (10, 20), (10, 30), (20, 30)]


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("operator", "oper"), ("hopefulness", "hope"), ("formalize", "formal"), ("electrical", "electr"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is")])
def test_stems(word, stem):
    assert text_clean.Stemmer()(word) == stem


def test_relevance_without_redundancy():
    v = np.array([[1.0, 0], [1.0, 0.01], [0, 1.0]])
    assert text_models.mmr(np.array([1.0, 0.99, 0.5]), v, 2, 0.5) == [0, 2]
    assert text_models.by_odds_ratio([0.5, 0.3, 0.05, 0.15], 0.4) == [0, 1, 3]


def test_clusters(spark):
    pts = [0.0, 0.1, 0.2, 5.0, 5.1, 5.2, 9.0]
    pairs = [(i, j, abs(a - b)) for i, a in enumerate(pts) for j, b in enumerate(pts) if i != j]
    got = {r.node: r.cluster for r in learning.dbscan(spark.createDataFrame(pairs, "src long, dst long, dist double"), 0.15, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: None}
    e = spark.createDataFrame([(1, 2, 0.9, 0), (2, 3, 0.8, 0), (1, 3, 0.9, 0), (3, 4, 0.2, 0)], "a long, b long, weight double, component int")
    assert {r.node: r.cluster for r in learning.edge_clusters(e, 0.5).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_surrogate_finds_the_weights():
    w = learning.local_surrogate({"x": 1.0, "y": 2.0}, lambda m: 3 * m[:, 0] - m[:, 1], {"x": 1.0, "y": 1.0})
    assert w["x"] == pytest.approx(3) and w["y"] == pytest.approx(-1)


def test_components_of_shuffled_chains(spark):
    """Long chains whose numbers are in no order settle, for numbers and for strings; AQE on."""
    import random

    r = random.Random(3)
    for make in (int, "n{:05d}".format):
        want, links = {}, []
        for n, base in ((9, 0), (53, 1000), (301, 5000)):
            ids = [make(base + i) for i in range(n)]
            r.shuffle(ids)
            links += list(zip(ids, ids[1:]))
            want |= dict.fromkeys(ids, min(ids))
        links += [(make(9000), make(9000)), (None, make(1)), (make(2), None)]
        kind = "long" if make is int else "string"
        got = {x.node: x.component for x in learning.linked_clusters(spark.createDataFrame(links, f"a {kind}, b {kind}")).collect()}
        assert got == want
    assert learning.linked_clusters(spark.createDataFrame([], "a long, b long")).count() == 0
