"""What larger tables ask of operators: counts beyond whole numbers' cubes, points with many copies, cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import learners, learning, neighbours, similarity, twosample


def test_kruskal_beyond_the_cube_of_a_long(spark):
    n, kinds = 2_200_000, 7  # n ** 3 passes 2 ** 63
    d = spark.range(n).select((F.col("id") % kinds).cast("double").alias("x"), (F.col("id") % 3).alias("g"))
    i = np.arange(n)
    k = np.bincount(i % kinds)
    rank = np.cumsum(k) - (k - 1) / 2
    h = 12 / (n * (n + 1)) * sum(rank[i[i % 3 == g] % kinds].sum() ** 2 / (i % 3 == g).sum() for g in range(3)) - 3 * (n + 1)
    want = h / (1 - float((k.astype(float) ** 3 - k).sum()) / (float(n) ** 3 - n))
    got = twosample.kruskal(d, "x", F.col("g")).first()["h"]
    assert math.isclose(got, want, rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("leaf", [5, 1000])
def test_nearest_points_are_those_of_all_distances(spark, leaf):
    """Copies, ties, groups smaller than k, and places far from all cells."""
    rng = np.random.default_rng(3)
    spread = [(i, [float(x) for x in rng.integers(0, 6, 2)], "a") for i in range(300)]
    spread += [(1000 + i, [float(x) for x in rng.normal(size=2)], "b") for i in range(200)]
    spread += [(2000, [0.0, 0.0], "c"), (2001, [9.0, 9.0], "c"), (2002, [9.0, None], "c"), (-7, [90.0, 90.0], "a")]
    d = spark.createDataFrame(spread, "key long, v array<double>, group string").repartition(3)
    q = d.where("key % 3 = 0")
    for mean in (True, False):
        want = similarity.nearest_rows(q.where("key <> 2002"), d.where("key <> 2002"), 4, mean)
        got = neighbours.nearest_points(q, d, 4, mean, leaf)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_nearest_points_bring_few_keys_of_a_place(spark):
    """Ten thousand rows at one place: what is searched is the place, with k + 1 keys."""
    d = spark.range(10_000).select(F.col("id").alias("key"), F.array(F.lit(0.5), F.lit(0.5)).alias("v"), F.lit(None).cast("string").alias("group"))
    p = neighbours.points_of(d, 4).collect()
    assert [r["keys"] for r in p] == [[0, 1, 2, 3]]
    got = {(r.src, r.rank): (r.dst, r.dist) for r in neighbours.nearest_points(d, d, 3).collect()}
    assert len(got) == 30_000 and got[2, 3] == (3, 0.0) and got[9_999, 1] == (0, 0.0)


def test_rounds_of_groups_go_on_over_batches(spark):
    """Many groups in one task, without a call for each, whatever the size of Arrow's batches."""
    d = spark.range(40).select((F.col("id") % 7).alias("grp"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("arm"), (F.col("id") / 40).alias("reward"))
    states = d.select("grp").distinct().withColumn("state", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = learners.batch_round(states, d, ["x", "y"], "optimisticThompsonSampler", 2)
        assert "CoGroup" not in out._jdf.queryExecution().toString()
        got = {r["grp"]: (r["actions"], r["state"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g in range(7):
        one = learners.create("optimisticThompsonSampler", ["x", "y"])
        for i in range(g, 40, 7):
            one.set_reward("x" if i % 3 == 0 else "y", i / 40)
        want[g] = ",".join(one.next_action() for _ in range(2)), one.state()
    assert got == want


def test_explanations_predict_for_many_rows_at_once(spark):
    def predict(m):
        assert len(m) > 500, "a call for each row"
        return 3 * m[:, 0] - m[:, 1] ** 2

    d = spark.range(0, 50, 1, 1).select("id", (F.col("id") / 7).alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    got = {(r["id"], r["feature"]): r["weight"] for r in learning.explain(d, "id", ["a", "b"], predict, {"a": 1.0, "b": 2.0}).collect()}
    rng = np.random.default_rng(1).normal(size=(500, 2))
    w = np.sqrt(np.exp(-(rng**2).sum(1) / (0.75**2 * 2)))[:, None]
    for i in (0, 13, 49):
        y = predict(np.vstack([np.array([i / 7, i % 5]) + rng * [1.0, 2.0], np.zeros((1, 2))]))[:500]
        x = np.linalg.lstsq(np.hstack([np.ones((500, 1)), rng]) * w, y * w[:, 0], rcond=None)[0]
        assert np.allclose(x[1:], [got[i, "a"], got[i, "b"]], atol=1e-8)


def test_products_find_the_same_nearest(spark):
    """Copies and ties too; pairs that can't be near are not summed column by column."""
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(300, 16)), rng.integers(0, 2, (200, 16)), np.zeros((9, 16))])
    v[7] = v[8] = v[400]
    k, g = rng.permutation(len(v)).astype(np.int64), [str(i % 2) for i in range(len(v))]
    for groups in (g, [None] * len(v)):
        got = similarity._best_by_products(k[::3], v[::3], groups[::3], k, v, groups, 5, False)
        want = []
        for a in range(0, len(v), 3):
            d = np.zeros(len(v))
            for c in range(16):
                d += (v[a, c] - v[:, c]) ** 2
            want += [(k[a], t, x) for x, t in sorted((x, t) for x, t, h in zip(np.sqrt(d), k, groups) if t != k[a] and h == groups[a])[:5]]
        assert sorted(zip(*got)) == sorted(want)


def test_siegel_shuffles_points_not_slopes(spark):
    from lumenforge.operators import series

    d = spark.createDataFrame([(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(9 + k)] + [(9, 0, 1.0)], "k int, i long, x double")
    out = series.siegel(d)
    assert "Join" not in out._jdf.queryExecution().toString()
    for k, got in ((r["k"], r["slope"]) for r in out.collect()):
        x = [float((i * 7 + k) % 11) for i in range(9 + k)]
        assert got == pytest.approx(np.median([np.median([(x[j] - x[i]) / (j - i) for j in range(len(x)) if j != i]) for i in range(len(x))]))
    assert out.count() == 3


def test_fligner_ranks_counts_not_rows(spark):
    from lumenforge.operators import normality

    d = spark.range(30_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 10).cast("double").alias("x"))
    out = normality.fligner(d, "x", "g")
    plan = out._jdf.queryExecution().toString()
    assert out.first()["fligner"] is not None and "_k" in plan


def test_dbscan_of_places_is_that_of_pairs(spark):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.integers(0, 25, 2) / 24], "ab"[i % 2]) for i in range(160)] + [(500, [0.5, 0.5], "alone")]
    d = spark.createDataFrame(rows, "key long, v array<double>, group string")
    far = lambda x, y: math.sqrt(((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) / 2)
    pairs = spark.createDataFrame([(a, b, far(x, y)) for a, x, g in rows for b, y, h in rows if a != b and g == h], "src long, dst long, dist double")
    want = {r["node"]: r["cluster"] for r in learning.dbscan(pairs, 0.06, 4).collect()}
    got = {r["node"]: r["cluster"] for r in learning.dbscan_places(d, 0.06, 4, 2).collect()}
    assert got == want and len(set(got.values())) > 3


@pytest.mark.parametrize("steps", [4, 40])
def test_near_clusters_are_those_of_their_edges(spark, steps):
    """Copies, equal means, rows without an edge, and no edges formed."""
    rng = np.random.default_rng(steps)
    rows = [(int(k), [float(x) for x in rng.integers(0, steps, 2) / steps], "ab"[i % 2]) for i, k in enumerate(rng.permutation(400))]
    d = spark.createDataFrame([*rows, (900, [9.0, 9.0], "a"), (901, [None, 0.5], "a"), (902, [0.5, 0.5], None)], "key long, v array<double>, group string").repartition(3)
    edges = []
    for i, x, g in rows:
        for j, y, h in rows:
            gap = math.sqrt((0.0 + (x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2) / 2)
            if g == h and i < j and gap < 0.2:
                edges.append((i, j, 1 - gap / 0.2, g))
    want = learning.edge_clusters(spark.createDataFrame(edges, "a long, b long, weight double, component string"), 0.3)
    got = learning.near_clusters(d, 0.2, 0.3)
    assert "Join" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("kinds", [2, 40, 100_000])
def test_discordant_pairs_are_those_of_all_pairs(spark, kinds):
    """Values that fill buckets of their own, ties in both columns; no row is sent once for each bit."""
    from lumenforge.operators import ordered

    rng = np.random.default_rng(kinds)
    x = rng.integers(0, kinds, 1500)
    y = np.where(rng.random(1500) < 0.3, 7, (x * 3 + rng.integers(-kinds, kinds, 1500)) // 2)
    d = spark.createDataFrame([*((float(p), int(q)) for p, q in zip(x, y, strict=True)), (None, 1)], "a double, b long").repartition(3)
    out = ordered.discordant(d, "a", "b")
    assert "_level" not in out._jdf.queryExecution().toString()
    got, i = out.first(), np.triu_indices(1500, 1)
    p, q = (np.sign(v[:, None] - v[None])[i] for v in (x, y))
    assert [got["n"], got["tied_a"], got["tied_b"], got["tied_both"], got["discordant"]] == [1500, (p == 0).sum(), (q == 0).sum(), ((p == 0) & (q == 0)).sum(), (p * q < 0).sum()]


def test_discordant_of_no_rows(spark):
    from lumenforge.operators import ordered

    got = ordered.discordant(spark.createDataFrame([], "a double, b double"), "a", "b").first()
    assert got["discordant"] == 0 and got["tied_a"] == 0


def test_item_sets_count_equal_transactions_once(spark):
    """A thousand transactions of three kinds: the levels work on three, with their numbers; repeated rows count once."""
    from lumenforge.operators import association

    kinds = F.array(*(F.array(*map(F.lit, k)) for k in (["a", "b", "c"], ["a", "b"], ["c", "d"])))
    d = spark.range(1000).select(F.col("id").alias("tid"), F.explode(kinds[(F.col("id") % 3).cast("int")]).alias("item"))
    got = {tuple(r["items"]): r["n"] for r in association.item_sets(d.unionAll(d), 3, 0.1).collect()}
    assert got == {("a",): 667, ("b",): 667, ("c",): 667, ("d",): 333, ("a", "b"): 667, ("a", "c"): 334, ("b", "c"): 334, ("c", "d"): 333, ("a", "b", "c"): 334}


def test_learners_of_trees_get_partitions_of_few_rows(spark):
    d = spark.range(0, 1000, 1, 2).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    assert learning.spread(d, 500) is d
    held = learning.spread(d, 100)
    sizes = [r["n"] for r in held.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 1000 and max(sizes) < 150
    assert learning.fit(d, "tree", ["x"], F.col("y")).numFeatures == 1


def test_word_vectors_train_in_tasks_of_few_words(spark):
    from lumenforge.operators import text_models

    d = spark.createDataFrame([(i, ["a", "b", "c", "d"][i % 3 :]) for i in range(60)], "id long, w array<string>")
    model, rows = text_models.word_vectors(d, F.col("w"), 4, task_words=50)
    assert model.getNumPartitions() == 4 and rows.count() == 60
    assert {r["word"] for r in model.getVectors().collect()} == set("abcd")
    assert text_models.word_vectors(d, F.col("w"), 4)[0].getNumPartitions() == 1


@pytest.mark.parametrize("support", [0.0, 0.3])
def test_item_sets_join_no_transactions(spark, monkeypatch, support):
    """With and without rare items; a level's counts come from the transactions' own items."""
    import itertools
    import re
    from collections import Counter

    from lumenforge.operators import association

    plans, stored = [], association.stored
    monkeypatch.setattr(association, "stored", lambda df, tag: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), stored(df, tag))[1])
    rng = np.random.default_rng(8)
    rows = [("uv"[t % 2], t, "abcdefg"[i]) for t in range(80) for i in set(rng.integers(0, 1 + t % 7, 5).tolist())]
    d = spark.createDataFrame(rows, "k string, tid long, item string")
    got = {(r["k"], *r["items"]): r["n"] for r in association.item_sets(d, 3, support, ["k"]).collect()}
    baskets = {(k, t): sorted(i for _, s, i in rows if s == t) for k, t, _ in rows}
    counts = Counter((k, *c) for (k, _), v in baskets.items() for n in (1, 2, 3) for c in itertools.combinations(v, n))
    total = Counter(k for k, _ in baskets)
    assert got == {s: n for s, n in counts.items() if n > support * total[s[0]]}
    assert len(plans) > 3 and not any(re.search(r"Join [^\n]*\(tid#", p) for p in plans)


def test_spread_bounds_the_rows_of_a_partition(spark):
    """However a file was split, a learner's task reads so many rows at most, and all rows are read."""
    most = lambda d: [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    for n in (5_000, 50_000):  # ten times the rows, the same bound
        d = spark.range(0, n, 1, 2)
        got = most(learning.spread(d, 1_000))
        assert sum(got) == n and max(got) <= 1_000 + 2  # rounding of each input partition
    assert learning.spread(d, 50_000) is d
