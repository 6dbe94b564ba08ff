"""Named datasets and the exploration operators on them.

A dataset is a column of a DataFrame with a kind (numeric, categorical or binary) and notes.  Two
datasets of one DataFrame can be compared row by row; any two can be compared as samples.
Every method gives a DataFrame and collects nothing but bounded statistics.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import clusters, contingency, describe, information, normality, learning, models, outliers, per_series, sampling, series, similarity, twosample
from .operators.ordered import quantiles

KINDS = ("numeric", "categorical", "binary")


@dataclass
class Dataset:
    frame: DataFrame
    column: str
    kind: str
    order: str | None = None
    notes: list[str] = field(default_factory=list)


class Explorer:
    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    # datasets

    def add(self, frame: DataFrame, *columns: str, kind: str = "numeric", order: str | None = None) -> None:
        """Registers columns by name; order: the column that gives a series its order."""
        if kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        for c in columns:
            frame[c]
            self.held[c] = Dataset(frame, c, kind, order)

    def add_list(self, name: str, values: list, kind: str = "numeric") -> None:
        frame = self.spark.createDataFrame([(i, v) for i, v in enumerate(values)], ["_i", name])
        self.add(frame, name, kind=kind, order="_i")

    def remove(self, name: str) -> None:
        del self.held[name]

    def names(self) -> list[tuple[str, str]]:
        return sorted((k, d.kind) for k, d in self.held.items())

    def note(self, name: str, text: str) -> None:
        self.held[name].notes.append(text)

    def notes(self, name: str) -> list[str]:
        return list(self.held[name].notes)

    def save(self, path: str) -> None:
        for k, d in self.held.items():
            keep = d.frame.select(F.col(d.column).alias(k), *([F.col(d.order).alias("_order")] if d.order else []))
            keep.write.option("path", f"{path}/{k}").format("parquet").mode("overwrite").save()

    def restore(self, path: str, kinds: dict[str, str]) -> None:
        for k, kind in kinds.items():
            f = self.spark.read.parquet(f"{path}/{k}")
            self.add(f, k, kind=kind, order="_order" if "_order" in f.columns else None)

    def kinds_of(self, frame: DataFrame, *columns: str) -> DataFrame:
        """binary, integer, float, categorical or mixed, by the values."""
        return describe.type_profile(frame, list(columns))

    def _get(self, name: str, *kinds: str) -> Dataset:
        d = self.held[name]
        if kinds and d.kind not in kinds:
            raise ValueError(f"{name} is {d.kind}, not {' or '.join(kinds)}")
        return d

    def one(self, name: str, *kinds: str) -> DataFrame:
        d = self._get(name, *kinds)
        return d.frame.select(F.col(d.column).alias("x"))

    def pair(self, a: str, b: str) -> DataFrame:
        x, y = self._get(a), self._get(b)
        if x.frame is not y.frame:
            raise ValueError(f"{a} and {b} are not columns of one DataFrame")
        return x.frame.select(F.col(x.column).alias("x"), F.col(y.column).alias("y"))

    def samples(self, *names: str) -> DataFrame:
        """x, g: the values of all, with the number of the dataset."""
        out = None
        for i, n in enumerate(names):
            d = self.one(n, "numeric").select(F.col("x").cast("double").alias("x"), F.lit(i).alias("g"))
            out = d if out is None else out.unionAll(d)
        return out

    def series(self, name: str) -> DataFrame:
        """k, i, x: the whole dataset as one series, numbered by its order.  A series is one task's work."""
        d = self._get(name, "numeric", "binary")
        if d.order is None:
            raise ValueError(f"{name} has no order")
        w = Window.partitionBy("k").orderBy("_o")
        return d.frame.select(F.lit(0).alias("k"), F.col(d.order).alias("_o"), F.col(d.column).cast("double").alias("x")).select("k", (F.row_number().over(w) - 1).alias("i"), "x")

    # description

    def stats(self, name: str) -> DataFrame:
        return describe.num_stats(self.one(name, "numeric"), "x")

    def stats_categorical(self, name: str) -> DataFrame:
        return describe.cat_stats(self.one(name, "categorical", "binary"), "x")

    def frequencies(self, name: str, bins: int = 20) -> DataFrame:
        return describe.histogram(self.one(name, "numeric"), "x", bins)

    def cumulative_frequencies(self, name: str, bins: int = 20) -> DataFrame:
        return describe.cumulative(self.frequencies(name, bins))

    def extremes(self, name: str, n: int = 5) -> DataFrame:
        d = self.one(name, "numeric").select("x", F.monotonically_increasing_id().alias("i"))
        return describe.extremes(d, "x", "i", n).select("x", "side")

    def bootstrap_extremes(self, name: str, draws: int, repeats: int) -> DataFrame:
        d = self.one(name, "numeric").select("x", F.monotonically_increasing_id().alias("i"))
        return sampling.bootstrap_extremes(d, "i", "x", draws, repeats)

    def percentile_of(self, name: str, value: float) -> DataFrame:
        return describe.percentile_of(self.one(name, "numeric"), "x", value)

    def value_at(self, name: str, percent: float) -> DataFrame:
        return quantiles(self.one(name, "numeric"), "x", {"value": percent / 100})

    def less_than(self, name: str, value: float) -> DataFrame:
        return self.one(name, "numeric").where(F.col("x") < value)

    def greater_than(self, name: str, value: float) -> DataFrame:
        return self.one(name, "numeric").where(F.col("x") > value)

    def value_counts(self, name: str, most: int | None = None) -> DataFrame:
        """Values that occur more than once if numeric, all if categorical; the most frequent first."""
        c = self.one(name).groupBy("x").agg(F.count("*").alias("n"))
        c = c.where("n > 1") if self._get(name).kind == "numeric" else c
        return c.orderBy(F.desc("n"), "x").limit(most) if most else c

    def nulls(self, name: str) -> DataFrame:
        return describe.null_counts(self.one(name), ["x"])

    def character_counts(self, name: str) -> DataFrame:
        return self.one(name, "categorical").select("x", *describe.char_counts(self.one(name), "x"))

    def length_stats(self, name: str) -> DataFrame:
        d = self.one(name, "categorical")
        return d.agg(*describe.stats_of(d, F.length("x"), "len"))

    def grouped(self, name: str, by: str, width: float | None = None) -> DataFrame:
        """Count and mean by a category, or by bins of a number."""
        g = F.floor(F.col("y") / width) if width else F.col("y")
        return self.pair(name, by).groupBy(g.alias("g")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"))

    def range_percentile(self, name: str, low: float, high: float) -> DataFrame:
        """Share of values from low to high, in percent."""
        d = self.one(name, "numeric")
        return d.agg((F.count_if(F.col("x").between(low, high)) * 100.0 / F.count("x")).alias("percent"))

    def monotonic(self, name: str) -> DataFrame:
        """Whether the dataset only rises, or only falls, in its order."""
        return describe.monotonic(self.series(name), "k", ["i"], "x").drop("k")

    def same_size(self, *names: str) -> None:
        """Raises if the datasets' numbers of values differ."""
        n = {k: self.one(k).where(F.col("x").isNotNull()).count() for k in names}
        if len(set(n.values())) > 1:
            raise ValueError(f"sizes differ: {n}")

    # information and association

    def _coded(self, name: str, c: str, bins: int) -> Column:
        if self._get(name).kind != "numeric":
            return F.col(c).cast("string")
        r = self.one(name).agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
        w = (float(r["hi"]) - float(r["lo"])) / bins or 1.0
        return F.least(F.floor((F.col(c) - float(r["lo"])) / w), F.lit(bins - 1)).cast("string")

    def entropy(self, name: str, bins: int = 20) -> DataFrame:
        return information.entropy_of(self.one(name).groupBy(self._coded(name, "x", bins).alias("v")).agg(F.count("*").alias("n")))

    def mutual_information(self, a: str, b: str, bins: int = 20) -> DataFrame:
        d = self.pair(a, b).select(self._coded(a, "x", bins).alias("a"), self._coded(b, "y", bins).alias("b"))
        return contingency.measures(d, "a", "b").select("mutual_info")

    def conditional_information(self, a: str, b: str, given: str, bins: int = 20) -> DataFrame:
        """Mutual information of a and b within the values of a third dataset."""
        frame = self._get(a).frame
        if any(self._get(k).frame is not frame for k in (b, given)):
            raise ValueError("not columns of one DataFrame")
        c = information.joint(frame, {k: self._coded(n, self._get(n).column, bins) for k, n in (("a", a), ("b", b), ("z", given))})
        h = lambda *keys: information.entropy_of(c.groupBy(*keys).agg(F.sum("n").alias("n")))
        parts = h("a", "z").toDF("az"), h("b", "z").toDF("bz"), h("z").toDF("z"), h("a", "b", "z").toDF("abz")
        one = parts[0]
        for p in parts[1:]:
            one = one.crossJoin(F.broadcast(p))  # one row each
        return one.select((F.col("az") + F.col("bz") - F.col("z") - F.col("abz")).alias("mutual_info"))

    def relative_entropy(self, a: str, b: str, bins: int = 20) -> DataFrame:
        """Of two samples over bins of their common range, each bin of either counting one more."""
        s = self.samples(a, b)
        r = s.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        n = F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))
        c = s.crossJoin(F.broadcast(r)).groupBy(n.alias("b")).agg((F.count_if(F.col("g") == 0) + 1).alias("p"), (F.count_if(F.col("g") == 1) + 1).alias("q"))
        t = c.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
        p, q = F.col("p") / F.col("all_p"), F.col("q") / F.col("all_q")
        return c.crossJoin(F.broadcast(t)).agg(F.sum(p * F.log(p / q)).alias("kl"))

    def features(self, target: str, *names: str, algorithm: str = "mrmr", bins: int = 10) -> list[tuple[str, float]]:
        frame = self._get(target).frame
        cols = {n: self._coded(n, self._get(n).column, bins) for n in names}
        return information.feature_scores(information.information_table(frame, cols, self._coded(target, self._get(target).column, bins)), algorithm)

    def contingency_table(self, a: str, b: str) -> DataFrame:
        return contingency.crosstab(self.pair(a, b), "x", "y")

    def chi_square(self, a: str, b: str) -> DataFrame:
        return normality.chi_square_test(self.pair(a, b), "x", "y")

    def anova(self, value: str, group: str) -> DataFrame:
        return normality.anova_test(self.pair(value, group), "y", "x")

    def pearson(self, a: str, b: str) -> DataFrame:
        return normality.correlation_test(self.pair(a, b), "x", "y")

    point_biserial = pearson

    def spearman(self, a: str, b: str) -> DataFrame:
        return series.spearman(self.pair(a, b), "x", "y")

    def kendall(self, a: str, b: str) -> DataFrame:
        return series.kendall(self.pair(a, b), "x", "y")

    def covariance(self, *names: str) -> DataFrame:
        return series.correlations(self._get(names[0]).frame, [self._get(n, "numeric").column for n in names])

    def linear_fit(self, x: str, y: str) -> DataFrame:
        return series.linear_fit(self.pair(x, y), F.col("x"), F.col("y"))

    # series

    def difference(self, name: str, lag: int = 1) -> DataFrame:
        return series.difference(self.series(name), lag)

    def trend(self, name: str) -> DataFrame:
        return series.linear_fit(self.series(name), F.col("i"), F.col("x"))

    def detrended(self, name: str) -> DataFrame:
        return series.detrend(self.series(name))

    def components(self, name: str, period: int) -> DataFrame:
        return series.seasonal(self.series(name), period)

    def autocorrelation(self, name: str, lags: int = 10) -> DataFrame:
        return series.autocorrelation(self.series(name), lags)

    def noise(self, name: str, size: int | None = None) -> DataFrame:
        """Deviation of differences, or of distances to a moving average of ``size``."""
        s = self.series(name)
        return series.moving_average_noise(s, size) if size else series.difference(s).agg(F.stddev_pop("d").alias("noise"))

    def _whole(self, name: str, f, columns: str) -> DataFrame:
        return per_series.per_series(self.series(name), f, columns).drop("k")

    def partial_autocorrelation(self, name: str, lags: int = 10) -> DataFrame:
        return self._whole(name, lambda x: per_series.partial_autocorrelation(x, lags), "lag long, pacf double")

    def hurst(self, name: str) -> DataFrame:
        return self._whole(name, lambda x: [(per_series.hurst(x),)], "hurst double")

    def approximate_entropy(self, name: str, m: int = 2, r: float = 0.2) -> DataFrame:
        return self._whole(name, lambda x: [(per_series.approximate_entropy(x, m, r),)], "entropy double")

    def one_space_entropy(self, name: str) -> DataFrame:
        return normality.one_space_entropy(self.one(name, "numeric"), "x")

    def fourier(self, name: str) -> DataFrame:
        return self._whole(name, per_series.spectrum, "freq long, re double, im double")

    def discord(self, name: str, size: int) -> DataFrame:
        return self._whole(name, lambda x: per_series.discord(x, size), "at long, dist double")

    def test_unit_root(self, name: str, lags: int = 1) -> DataFrame:
        return self._whole(name, lambda x: per_series.adf(x, lags), "t double, c1 double, c5 double, c10 double, stationary boolean")

    def test_level(self, name: str) -> DataFrame:
        return self._whole(name, per_series.kpss, "stat double, p double, lags long")

    def cross_correlation(self, a: str, b: str, lags: int = 10) -> DataFrame:
        x, y = self._get(a), self._get(b)
        if x.frame is not y.frame or x.order is None:
            raise ValueError(f"{a} and {b} are not columns of one ordered DataFrame")
        w = Window.partitionBy("k").orderBy("_o")
        d = x.frame.select(F.lit(0).alias("k"), F.col(x.order).alias("_o"), F.col(x.column).cast("double").alias("x"), F.col(y.column).cast("double").alias("y"))
        return series.cross_correlation(d.withColumn("i", F.row_number().over(w) - 1), lags).drop("k")

    def theil_sen(self, name: str) -> DataFrame:
        return series.theil_sen(self.series(name)).drop("k")

    def siegel(self, name: str) -> DataFrame:
        return series.siegel(self.series(name)).drop("k")

    # clusters and components

    def _columns(self, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
        return self._get(names[0]).frame, [self._get(n, "numeric").column for n in names]

    def k_means(self, key: str, *names: str, k: int = 3, rounds: int = 10, seed: int = 1) -> DataFrame:
        """Centres from spread starts; key: a column that tells rows apart."""
        frame, cols = self._columns(names)
        got = models.kmeans(frame, cols, clusters.spread_starts(frame, key, cols, k, seed), rounds)
        return self.spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(got)], "k int, " + ", ".join(f"`{n}` double" for n in names))

    def gaussian_mixture(self, *names: str, k: int = 2, rounds: int = 10, seed: int = 1) -> DataFrame:
        from pyspark.ml.clustering import GaussianMixture

        frame, cols = self._columns(names)
        model = GaussianMixture(k=k, seed=seed, maxIter=rounds).fit(learning.assembled(frame, cols))
        rows = [(i, float(w), [float(x) for x in g.mean]) for i, (w, g) in enumerate(zip(model.weights, model.gaussians))]
        return self.spark.createDataFrame(rows, "k int, weight double, mean array<double>")

    def principal_components(self, *names: str, k: int = 2) -> DataFrame:
        """component, share of variance, loadings."""
        from pyspark.ml.feature import PCA

        frame, cols = self._columns(names)
        model = PCA(k=k, inputCol="features", outputCol="p").fit(learning.assembled(frame, cols))
        loads = model.pc.toArray()
        return self.spark.createDataFrame([(i, float(model.explainedVariance[i]), [float(x) for x in loads[:, i]]) for i in range(k)], "component int, share double, loadings array<double>")

    def forest_outliers(self, key: str, *names: str) -> DataFrame:
        frame, cols = self._columns(names)
        return outliers.isolation_forest(frame, key, cols)

    def local_outliers(self, key: str, block: str, *names: str, k: int = 5) -> DataFrame:
        """Local outlier factor among the rows of a block, a column that groups rows."""
        frame, cols = self._columns(names)
        p = similarity.grouped_pairs(frame.select(key, block, *cols), key, block, cols)
        both = p.select(F.explode(F.array(F.struct(F.col("k1").alias("src"), F.col("k2").alias("dst"), "dist"), F.struct(F.col("k2").alias("src"), F.col("k1").alias("dst"), "dist"))).alias("x")).select("x.*")
        return outliers.local_outlier_factor(both, k)

    # shape and outliers

    def test_jarque_bera(self, name: str) -> DataFrame:
        return twosample.jarque_bera(self.one(name, "numeric"), "x")

    def test_dagostino(self, name: str) -> DataFrame:
        return normality.dagostino(self.one(name, "numeric"), "x")

    def test_shapiro(self, name: str) -> DataFrame:
        return self._whole(name, per_series.shapiro_wilk, "w double, p double")

    def test_anderson(self, name: str, law: str = "norm") -> DataFrame:
        d = self.one(name, "numeric")
        return twosample.anderson_normal(d, "x") if law == "norm" else normality.anderson(d, "x", law)

    def zscore_outliers(self, name: str, z: float = 3.0) -> DataFrame:
        d = self.one(name, "numeric")
        m = d.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        return d.crossJoin(F.broadcast(m)).where(F.abs((F.col("x") - F.col("m")) / F.col("s")) > z).select("x")

    def covariance_outliers(self, *names: str, robust: float = 0.75) -> DataFrame:
        return outliers.mahalanobis(self._get(names[0]).frame, [self._get(n, "numeric").column for n in names], robust)

    # two samples

    def _two(self, f, a: str, b: str) -> DataFrame:
        return f(self.samples(a, b), "x", F.col("g") == 0)

    def test_ks(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.ks, a, b)

    def test_student(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.t_statistic, a, b)

    def test_mann_whitney(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.mann_whitney, a, b)

    def test_cramer_von_mises(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.cramer_von_mises, a, b)

    def test_wasserstein(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.wasserstein, a, b)

    def test_anderson_two(self, a: str, b: str) -> DataFrame:
        return self._two(normality.anderson_two, a, b)

    def test_epps_singleton(self, a: str, b: str) -> DataFrame:
        return self._two(normality.epps_singleton, a, b)

    def test_ansari(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.ansari, a, b)

    def test_mood_scale(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.mood_scale, a, b)

    def test_mood_median(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.median_test, a, b)

    def test_zhang(self, a: str, b: str) -> DataFrame:
        return self._two(twosample.zhang, a, b).crossJoin(F.broadcast(self._two(normality.zhang_c, a, b)))  # one row each

    def test_kruskal(self, *names: str) -> DataFrame:
        return twosample.kruskal(self.samples(*names), "x", F.col("g"))

    def test_bartlett(self, *names: str) -> DataFrame:
        return twosample.bartlett(self.samples(*names), "x", "g")

    def test_levene(self, *names: str) -> DataFrame:
        return twosample.levene(self.samples(*names), "x", "g")

    def test_fligner(self, *names: str) -> DataFrame:
        return normality.fligner(self.samples(*names), "x", "g")

    def test_wilcoxon(self, a: str, b: str) -> DataFrame:
        return twosample.wilcoxon(self.pair(a, b), "x", "y")

    def test_friedman(self, *names: str) -> DataFrame:
        frame = self._get(names[0]).frame
        return twosample.friedman(frame, [self._get(n, "numeric").column for n in names])
