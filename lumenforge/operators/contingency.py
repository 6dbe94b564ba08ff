"""Statistics of contingency tables.  One count by (a, b); all else works on the table of counts,
whose size is the product of the two cardinalities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bandits import uniform


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def shares(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n with row, column and grand totals (r, c, t); absent cells are not there."""
    c = crosstab(df, a, b)
    r = c.groupBy("a").agg(F.sum("n").alias("r"))
    k = c.groupBy("b").agg(F.sum("n").alias("c"))
    t = c.agg(F.sum("n").alias("t"))
    return c.join(r, "a").join(k, "b").crossJoin(F.broadcast(t))  # t: one row


def measures(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi-square, Cramer index and V, concentration, mutual information, Theil U of b given a."""
    s = shares(df, a, b)
    n, r, c, t = (F.col(x).cast("double") for x in "nrct")
    base = s.agg(F.sum(n * n / (r * c)).alias("q"), F.countDistinct("a").alias("ra"), F.countDistinct("b").alias("cb"), F.first("t").alias("t"), F.sum(n * n / (t * r)).alias("g"), F.sum(n / t * F.log(n * t / (r * c))).alias("mi"))
    col = crosstab(df, a, b).groupBy("b").agg(F.sum("n").alias("c"))
    p = F.col("c") / F.col("t")
    col = col.crossJoin(F.broadcast(crosstab(df, a, b).agg(F.sum("n").alias("t")))).agg(F.sum(p * p).alias("p2"), F.sum(-p * F.log(p)).alias("h"))
    x = base.crossJoin(F.broadcast(col))
    idx = (F.col("q") - 1) / (F.least("ra", "cb") - 1)
    return x.select(((F.col("q") - 1) * F.col("t")).alias("chi_square"), idx.alias("cramer_index"), F.sqrt(idx).alias("cramer_v"), ((F.col("g") - F.col("p2")) / (1 - F.col("p2"))).alias("concentration"), F.col("mi").alias("mutual_info"), (F.col("mi") / F.col("h")).alias("uncertainty"))


def class_stats(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """value, pos, neg, and totals all_pos, all_neg."""
    g = df.groupBy(F.col(value).alias("value")).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))))


def affinity(df: DataFrame, value: str, positive: Column) -> DataFrame:
    s = class_stats(df, value, positive)
    p, n = F.col("pos") / F.col("all_pos"), F.col("neg") / F.col("all_neg")
    return s.select("value", (p / (1 - p) / (n / (1 - n))).alias("odds"), (p - n).alias("diff"), (p * (1 - n)).alias("min_risk"), (p * F.log(p / n)).alias("kl"))


def supervised_ratio(df: DataFrame, value: str, positive: Column, scale: int = 100) -> DataFrame:
    return class_stats(df, value, positive).select("value", F.expr(f"pos * {scale} div (pos + neg)").alias("code"))


def weight_of_evidence(df: DataFrame, value: str, positive: Column, scale: int = 100) -> DataFrame:
    neg = F.greatest("neg", F.lit(1))
    return class_stats(df, value, positive).select("value", (F.log((F.col("pos") / F.col("all_pos")) / (neg / F.col("all_neg"))) * scale).cast("int").alias("code"))


def leave_one_out(df: DataFrame, value: str, target: str, reg: float = 10.0, noise: float = 0.0, seed: int = 1, key: str | None = None, train: bool = True) -> DataFrame:
    """Adds ``code``; noise is normal, cut at two deviations, by a hash of the key."""
    s = df.groupBy(value).agg(F.count("*").alias("_n"), F.sum(target).alias("_s"))
    code = (F.col("_s") - F.col(target)) / (F.col("_n") - 1 + reg) if train else F.col("_s") / (F.col("_n") + reg)
    if noise:
        z = F.sqrt(-2 * F.log(uniform(seed, F.col(key)))) * F.cos(2 * 3.141592653589793 * uniform(seed + 1, F.col(key)))
        code = code * (1 + noise * F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)))
    return df.join(s, value).withColumn("code", code).drop("_n", "_s")


def confusion(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    one = df.agg(F.count_if(actual & predicted).alias("tp"), F.count_if(~actual & predicted).alias("fp"), F.count_if(~actual & ~predicted).alias("tn"), F.count_if(actual & ~predicted).alias("fn"))
    return one.select("*", (F.col("tp") / (F.col("tp") + F.col("fn"))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))).alias("accuracy"))


def calibration(df: DataFrame, p: Column, y: Column, bins: int = 10, threshold: float = 0.5) -> DataFrame:
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("confidence"), F.avg(((p > threshold) == (y == 1)).cast("int")).alias("accuracy"))


def rule(df: DataFrame, condition: Column, consequent: Column, name: str) -> DataFrame:
    one = df.agg(F.count_if(condition).alias("n"), F.count_if(condition & consequent).alias("hit"), F.count("*").alias("all"))
    p = F.col("hit") / F.col("n")
    ent = F.when((p > 0) & (p < 1), 1 + p * F.log2(p) + (1 - p) * F.log2(1 - p)).otherwise(1.0)
    return one.select(F.lit(name).alias("rule"), "n", p.alias("confidence"), ent.alias("entropy_confidence"), (F.col("n") / F.col("all")).alias("support"))


def conformal_bound(df: DataFrame, score: Column, confidence: float) -> DataFrame:
    """The int(conf * n)-th smallest score from 0, by counts of distinct scores."""
    from .ordered import running

    c = running(df.groupBy(score.alias("s")).count(), "s", {"cum": F.col("count")})
    n = df.agg(F.floor(F.count("*") * confidence).alias("k"))
    return c.crossJoin(F.broadcast(n)).where("cum > k").agg(F.min("s").alias("bound"))


def regression_metrics(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """r2, mae, mse."""
    e = actual - predicted
    one = df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.var_pop(actual).alias("v"))
    return one.select((1 - F.col("mse") / F.col("v")).alias("r2"), "mae", "mse")


def class_metrics(df: DataFrame, actual: Column, p: Column, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and binary cross entropy of probabilities."""
    c = confusion(df, actual, p > threshold)
    q = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), p))
    h = df.agg(F.avg(-F.when(actual, F.log(q)).otherwise(F.log(1 - q))).alias("cross_entropy"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    return c.select("accuracy", "precision", "recall", f1.alias("f1")).crossJoin(F.broadcast(h))  # one row each


def confusion_table(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def integer_percents(c: DataFrame) -> DataFrame:
    """Recall, precision and accuracy of confusion counts in whole percents."""
    return c.select(F.expr("100 * tp div (tp + fn)").alias("recall"), F.expr("100 * tp div (tp + fp)").alias("precision"), F.expr("100 * (tp + tn) div (tp + fp + tn + fn)").alias("accuracy"))


def proxy_lift(df: DataFrame, protected: Column, proxy: Column, positive: Column) -> DataFrame:
    """Bounds of the lift of a protected group from a proxy for it: b1 = P(proxy given protected), b2 = P(protected given proxy)."""
    b = df.agg((F.count_if(protected & proxy) / F.count_if(protected)).alias("b1"), (F.count_if(protected & proxy) / F.count_if(proxy)).alias("b2"), (F.count_if(proxy & positive) / F.count_if(proxy)).alias("q"), (F.count_if(positive) / F.count("*")).alias("p"))
    b1, b2, q, p = (F.col(x) for x in ("b1", "b2", "q", "p"))
    return b.select("b1", "b2", (b1 / b2 * (b2 + q - 1) / p).alias("lift_min"), ((1 - b1 + q * b1 / b2) / p).alias("lift_max"))


def stats_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mean of products of deviations over the population deviations, taken from a first pass."""
    m = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return df.crossJoin(F.broadcast(m)).agg((F.avg((F.col(a) - F.col("ma")) * (F.col(b) - F.col("mb"))) / (F.first("sa") * F.first("sb"))).alias("r"))


def smoothed_conditionals(df: DataFrame, value: str, cls: str) -> DataFrame:
    """value, cls, n, p = P(value given cls), a value not met in a class counting one there."""
    c = df.groupBy(F.col(value).alias("value"), F.col(cls).alias("cls")).agg(F.count("*").alias("n"))
    every = c.select("value").distinct().crossJoin(F.broadcast(c.select("cls").distinct()))  # values by classes
    full = every.join(c, ["value", "cls"], "left").select("value", "cls", F.coalesce("n", F.lit(1)).alias("n"))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("cls")))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))
