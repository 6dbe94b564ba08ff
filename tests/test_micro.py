"""Small fixtures with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.functions import pvalues
from lumenforge.operators import association, bandits, contingency, encoding, information, models, normality, per_series, sequences, series, similarity, simulate, twosample


def table(spark, cells):
    rows = [(f"a{i}", f"b{j}") for i, row in enumerate(cells) for j, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_contingency(spark):
    m = contingency.measures(table(spark, [[10, 20, 30], [6, 9, 17]]), "a", "b").first()
    assert round(m.chi_square, 6) == 0.271575 and round(m.cramer_index, 6) == 0.002952 and round(m.cramer_v, 6) == 0.054331
    assert round(m.concentration, 6) == 0.001535 and round(m.mutual_info, 6) == 0.001489 and round(m.uncertainty, 6) == 0.001473


def test_split(spark):
    rows = [(s, c) for s, c, n in ((0, 1, 6), (0, 0, 2), (1, 1, 3), (1, 0, 3)) for _ in range(n)]
    r = information.split_stats(spark.createDataFrame(rows, "s int, c int"), F.col("s"), F.col("c") == 1).first()
    assert round(r.hellinger, 6) == 0.269773 and round(r.entropy, 6) == 0.892159
    assert round(r.gain, 6) == 0.048127 and round(r.gain_ratio, 6) == 0.048849
    e = information.entropy_of(spark.createDataFrame([(9,), (5,)], "n int")).first().h / math.log(2)
    assert round(e, 6) == 0.940286


def test_encodings(spark):
    rows = [("x", 1)] * 30 + [("x", 0)] * 10 + [("y", 1)] * 70 + [("y", 0)] * 290
    d = spark.createDataFrame(rows, "v string, y int")
    assert {r.value: r.code for r in contingency.supervised_ratio(d, "v", F.col("y") == 1).collect()}["x"] == 75
    assert {r.value: r.code for r in contingency.weight_of_evidence(d, "v", F.col("y") == 1, 100).collect()}["x"] == 219
    five = spark.createDataFrame([("x", 1), ("x", 1), ("x", 1), ("x", 0), ("x", 0)], "v string, y int")
    assert {round(r.code, 6) for r in contingency.leave_one_out(five, "v", "y").where("y = 1").collect()} == {0.142857}
    assert {round(r.code, 6) for r in contingency.leave_one_out(five, "v", "y", train=False).collect()} == {0.2}


def test_transitions_and_rates(spark):
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate("AABABBA")], "k int, i int, s string")
    n = {(r.src, r.dst): r.n for r in sequences.transition_counts(d, "k", ["i"], "s").collect()}
    assert n == {("A", "A"): 1, ("A", "B"): 2, ("B", "A"): 2, ("B", "B"): 1}
    p = {(r.src, r.dst): round(r.p, 6) for r in sequences.normalised(sequences.transition_counts(d, "k", ["i"], "s")).collect()}
    assert p == {("A", "A"): 0.333333, ("A", "B"): 0.666667, ("B", "A"): 0.666667, ("B", "B"): 0.333333}
    e = spark.createDataFrame([(1, 0, "A"), (1, 2, "B"), (1, 3, "A"), (1, 7, "B")], "k int, d int, s string")
    r = {(x.src, x.dst): round(x.rate, 6) for x in sequences.rates(e, "k", ["d"], "s", F.col("d") * 86400).collect()}
    assert r == {("A", "B"): 0.333333, ("B", "A"): 1.0}


def test_two_samples(spark):
    d = spark.createDataFrame([(float(x), True) for x in range(1, 6)] + [(float(x), False) for x in range(3, 8)], "x double, f boolean")
    k = twosample.ks(d, "x", F.col("f")).first()
    assert round(k.ks, 6) == 0.4 and round(k.critical, 6) == 0.774046 and not k.drift
    assert round(twosample.wasserstein(d, "x", F.col("f")).first().wasserstein, 9) == 2.0


def test_autocorrelation(spark):
    s = spark.createDataFrame([(1, i, float(i + 1)) for i in range(4)], "k int, i int, x double")
    assert series.autocorrelation(s, 1).first().acf == pytest.approx(0.25)


def test_affinity_fisher_ucb(spark):
    rows = [("x", 1)] * 6 + [("y", 1)] * 4 + [("x", 0)] * 2 + [("y", 0)] * 8
    a = {r.value: r for r in contingency.affinity(spark.createDataFrame(rows, "v string, y int"), "v", F.col("y") == 1).collect()}["x"]
    assert (round(a.odds, 6), round(a["diff"], 6), round(a.min_risk, 6), round(a.kl, 6)) == (6.0, 0.4, 0.48, 0.659167)
    n0 = [5 + math.sqrt(1) * s for s in (1, -1) for _ in range(5)]
    n1 = [3 + math.sqrt(2) * s for s in (1, -1) for _ in range(10)]
    f = models.fisher(spark.createDataFrame([(x, 0) for x in n0] + [(x, 1) for x in n1], "x double, c int"), "x", F.col("c") == 1).first()
    assert (round(f.pooled_variance, 6), round(f.log_odds, 6), round(f.boundary, 6)) == (1.666667, -0.693147, 4.577623)
    s = spark.createDataFrame([("a", 10, 0.5, 0.0), ("b", 90, 0.1, 0.0)], "arm string, n int, mean double, var double")
    assert {r.arm: round(r.score, 6) for r in bandits.ucb1(s).collect()}["a"] == 1.459705


def test_levenshtein(spark):
    d = spark.createDataFrame([("kitten", "sitting")], "a string, b string").select((1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))).alias("s"))
    assert round(d.first().s, 6) == 0.571429


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall_matches_pairs(spark, seed):
    r = np.random.default_rng(seed)
    x, y = r.integers(0, 12, 150), r.integers(0, 40, 150)
    sx, sy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    want = (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
    got = series.kendall(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "a int, b int"), "a", "b").first().tau
    assert got == pytest.approx(want)


def test_order_statistics_do_not_depend_on_buckets(spark, monkeypatch):
    from lumenforge.operators import ordered

    r = np.random.default_rng(3)
    d = spark.createDataFrame([(float(v), bool(f)) for v, f in zip(r.integers(0, 60, 400), r.integers(0, 2, 400))], "x double, f boolean")
    one = [twosample.ks(d, "x", F.col("f")).first(), twosample.mann_whitney(d, "x", F.col("f")).first(), normality.zhang_c(d, "x", F.col("f")).first()]
    monkeypatch.setattr(ordered, "bucket_of", lambda df, col, **k: F.lit(0))
    two = [twosample.ks(d, "x", F.col("f")).first(), twosample.mann_whitney(d, "x", F.col("f")).first(), normality.zhang_c(d, "x", F.col("f")).first()]
    for a, b in zip(one, two):
        assert [pytest.approx(v) for v in a] == list(b)


def test_tail_probabilities():
    assert pvalues.normal_sf(1.959963985) == pytest.approx(0.025)
    assert pvalues.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert pvalues.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)


def test_normal_quantile(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = [r.q for r in spark.createDataFrame([(x,) for x in p], "p double").select(normality.normal_quantile(F.col("p")).alias("q")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-7)


def test_series_statistics():
    r = np.random.default_rng(1)
    walk, noise = np.cumsum(r.normal(size=500)), r.normal(size=500)
    assert per_series.adf(noise)[0][-1] and not per_series.adf(walk)[0][-1]
    assert per_series.kpss(noise)[0][1] >= 0.05 and per_series.kpss(walk)[0][1] <= 0.05
    assert per_series.hurst(noise) < 0.75 < per_series.hurst(walk)
    wave = np.sin(np.arange(200) / 5)
    assert per_series.approximate_entropy(wave) < per_series.approximate_entropy(noise[:200])
    odd = np.tile([0.0, 1.0, 2.0, 1.0], 30)
    odd[60:63] = 9
    at, d = per_series.discord(odd, 4)[0]
    assert 56 <= at <= 63 and d > 5
    assert per_series.shapiro_wilk(noise)[0][1] > 0.01 > per_series.shapiro_wilk(np.exp(2 * noise))[0][1]
    ar = np.zeros(2000)
    for i in range(1, 2000):
        ar[i] = 0.6 * ar[i - 1] + r.normal()
    pacf = dict(per_series.partial_autocorrelation(ar, 3))
    assert abs(pacf[1] - 0.6) < 0.08 and abs(pacf[2]) < 0.08
    back = np.fft.irfft(np.array([a + 1j * b for _, a, b in per_series.spectrum(noise)]), 500)
    assert back == pytest.approx(noise)
    line = [x for _, x in per_series.holt_winters(np.arange(60.0) + np.tile([0, 3, 0, -3, 0], 12), 5, 5)]
    assert line == pytest.approx([60, 64, 62, 60, 64], abs=1.5)


def test_shapiro_of_known_sample():
    x = np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0])
    w, p = per_series.shapiro_wilk(x)[0]
    assert w == pytest.approx(0.79, abs=0.005) and p < 0.01


def test_samplers_and_bounds():
    g = np.random.default_rng(1)
    tri = simulate.rejection_sampler(lambda x: x / 2, 0, 2, 1.0)(g, 20_000)
    assert tri.mean() == pytest.approx(4 / 3, abs=0.02)
    mc = simulate.metropolis(lambda x: math.exp(-x * x / 2), 3.0, 1.5, 500, 3)(g, 5000)
    assert abs(mc.mean()) < 0.15 and abs(simulate.geweke(mc)) < 4
    burn, n = simulate.raftery_lewis(mc)
    assert 0 <= burn < 100 and n > 3000
    assert simulate.sample_bound(simulate.conjunctions([3, 4, 5]), 0.1, 0.95) == math.ceil((math.log(120) + math.log(20)) / 0.1)
    x, y = simulate.model_search(lambda v: (v - 1.3) ** 2, -4, 4)
    assert abs(x - 1.3) < 0.2 and y < 0.05
    assert simulate.temperature_for([1, 2, 1, 3]) == pytest.approx(-1.5 / math.log(0.8))


def test_item_sets_match_counting(spark):
    from collections import Counter
    from itertools import combinations

    r = np.random.default_rng(2)
    baskets = [(t, f"i{i}") for t in range(80) for i in sorted(set(r.integers(0, 8, 4).tolist()))]
    by = {}
    for t, i in baskets:
        by.setdefault(t, []).append(i)
    d = spark.createDataFrame(baskets, "tid int, item string")
    for k in (1, 2, 3):
        want = {c: n for c, n in Counter(c for b in by.values() for c in combinations(sorted(b), k)).items() if n > 0.05 * len(by)}
        got = {tuple(r[f"i{j}"] for j in range(1, k + 1)): r.n for r in association.frequent(d, k, 0.05).collect()}
        assert got == want


def test_search_in_blocks_matches_whole(spark):
    r = np.random.default_rng(5)
    d = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.random((60, 2)))], "id int, x double, y double")
    q = d.where("id % 5 = 0")
    dist = similarity.euclid("a", "b", ["x", "y"])
    rows = lambda block: sorted((a.src, a.dst, round(a.dist, 9)) for a in similarity.against(q, d, "id", dist, block=block).collect())
    assert rows(4096) == rows(3) and len(rows(3)) == 12 * 59


def test_vectors(spark):
    d = spark.createDataFrame([(3.0, 4.0)], "a double, b double").select(*encoding.distances([F.col("a"), F.col("b")], [F.lit(0.0), F.lit(1.0)])).first()
    assert (round(d.euclidean, 6), d.manhattan, d.chebyshev, round(d.cosine, 6)) == (4.242641, 6.0, 3.0, 0.2)


def test_nearest_rows_match_sorting(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(a), float(b)], "xy"[i % 2]) for i, (a, b) in enumerate(r.integers(0, 6, (90, 2)))]
    d = spark.createDataFrame(rows, "key long, v array<double>, group string")
    q = d.where("key % 4 = 0")
    want = {}
    for i, v, g in rows:
        if i % 4 == 0:
            near = sorted((math.sqrt(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) / 2), j) for j, w, h in rows if j != i and h == g)[:3]
            want |= {(i, j): (k + 1, round(x, 9)) for k, (x, j) in enumerate(near)}
    for block in (4096, 5):
        got = {(x.src, x.dst): (x["rank"], round(x.dist, 9)) for x in similarity.nearest_rows(q, d, 3, block=block).collect()}
        assert got == want
    assert similarity.nearest_rows(q.where("key < 0"), d, 3).count() == 0
