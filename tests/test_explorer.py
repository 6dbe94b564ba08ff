import pytest

from lumenforge.explorer import Explorer


@pytest.fixture(scope="module")
def held(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i, float(a), float(a + b), float(10 * b), str(int(a > 0)), "xyz"[i % 3]) for i, (a, b) in enumerate(r.normal(size=(300, 2)))]
    d = spark.createDataFrame(rows, "i long, a double, b double, c double, up string, kind string")
    e = Explorer(spark)
    e.add(d, "a", "b", "c", order="i")
    e.add(d, "up", "kind", kind="categorical")
    e.add_list("short", [1.0, 2.0, 3.0, 4.0])
    return e


def test_registry(held):
    held.note("a", "seeded")
    assert held.notes("a") == ["seeded"] and ("kind", "categorical") in held.names()
    with pytest.raises(ValueError):
        held.stats("kind")
    with pytest.raises(ValueError):
        held.pearson("a", "short")
    assert held.autocorrelation("short", 1).first().acf == pytest.approx(0.25)


TWO = ["test_ks", "test_student", "test_mann_whitney", "test_cramer_von_mises", "test_wasserstein", "test_anderson_two", "test_epps_singleton", "test_ansari", "test_mood_scale", "test_mood_median", "test_zhang", "test_kruskal", "test_bartlett", "test_levene", "test_fligner", "test_wilcoxon", "pearson", "spearman", "kendall", "mutual_information", "relative_entropy", "linear_fit"]


@pytest.mark.parametrize("method", TWO)
def test_two(held, method):
    got = getattr(held, method)("a", "c").collect()
    assert len(got) == 1 and all(v is not None for v in got[0])


ONE = ["stats", "frequencies", "cumulative_frequencies", "extremes", "nulls", "entropy", "trend", "noise", "partial_autocorrelation", "hurst", "approximate_entropy", "one_space_entropy", "fourier", "test_unit_root", "test_level", "test_jarque_bera", "test_dagostino", "test_shapiro", "test_anderson", "difference", "detrended"]


@pytest.mark.parametrize("method", ONE)
def test_one(held, method):
    assert getattr(held, method)("a").count() >= 1


def test_values(held):
    assert held.features("up", "a", "b", "c")[0][0] == "a"
    assert held.test_ks("a", "c").first().drift and not held.test_ks("a", "a").first().drift
    assert held.chi_square("up", "kind").first().degrees == 2
    assert held.value_at("short", 50).first().value == 2.5
    assert held.less_than("short", 3).count() == 2 and held.greater_than("short", 3).count() == 1
    assert {r.x: r.n for r in held.value_counts("kind").collect()} == {"x": 100, "y": 100, "z": 100}
    assert held.covariance_outliers("a", "b").count() == 300
    assert held.grouped("a", "kind").count() == 3 and held.discord("a", 4).count() == 1


def test_save_and_restore(held, spark, tmp_path):
    held.save(str(tmp_path))
    e = Explorer(spark)
    e.restore(str(tmp_path), {"a": "numeric", "kind": "categorical"})
    assert e.stats("a").first().n == 300 and e.trend("a").first().slope == held.trend("a").first().slope


def test_methods_over_several_datasets(spark):
    """Each against a plain computation."""
    import random

    import numpy as np

    r = random.Random(4)
    rows = [(i, r.gauss(0, 1) + (5 if i % 2 else 0), r.gauss(0, 1) + (5 if i % 2 else 0), float(i), "ab"[i % 2]) for i in range(200)]
    rows.append((200, 40.0, -30.0, 200.0, "a"))
    d = spark.createDataFrame(rows, "i long, x double, y double, up double, c string")
    e = Explorer(spark)
    e.add(d, "x", "y", "up", order="i")
    e.add(d, "c", kind="categorical")
    x = np.array([v[1] for v in rows])
    assert abs(e.range_percentile("x", 0, 5).first()[0] - 100 * np.mean((x >= 0) & (x <= 5))) < 1e-9
    assert e.monotonic("up").first().increasing and not e.monotonic("x").first().increasing
    e.same_size("x", "y")
    assert e.conditional_information("x", "y", "c").first()[0] >= 0
    assert abs(e.theil_sen("up").first().slope - 1) < 1e-9 and abs(e.siegel("up").first().slope - 1) < 1e-9
    c = {v.lag: v.ccf for v in e.cross_correlation("x", "x", 2).collect()}
    assert abs(c[0] - 1) < 1e-9
    got = sorted((round(v["x"]), round(v["y"])) for v in e.k_means("i", "x", "y", k=3, rounds=20).collect())
    assert (40, -30) in got and len(got) == 3
    assert abs(sum(v.weight for v in e.gaussian_mixture("x", "y").collect()) - 1) < 1e-9
    assert e.principal_components("x", "y").first().share > 0.5
    top = e.forest_outliers("i", "x", "y").orderBy("score", ascending=False).first()
    assert top.i == 200
    assert e.local_outliers("i", "c", "x", "y").orderBy("lof", ascending=False).first().src == 200
    for p in (10, 50, 90):
        assert abs(e.value_at("x", p).first().value - np.percentile(x, p)) < 1e-9
