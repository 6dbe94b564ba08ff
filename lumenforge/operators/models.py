"""Naive Bayes, tree splits, single steps of iterative learners, votes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nb_distribution(df: DataFrame, cls: str, features: dict[str, Column]) -> DataFrame:
    """Counts by (feature, value, class), all features in one aggregation of an unpivoted row."""
    long = df.select(F.col(cls).alias("cls"), F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), c.cast("string").alias("value")) for k, c in features.items()))).alias("f"))
    return long.groupBy("f.feature", "f.value", "cls").agg(F.count("*").alias("n"))


def nb_predict(df: DataFrame, key: list[str], dist: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Class of the greatest log posterior, add-one smoothing; dist has a row for each value and class."""
    # a column of scores for each class; the planner broadcasts a feature's values where they are few
    totals = {(r["feature"], r["cls"]): r["t"] for r in dist.groupBy("feature", "cls").agg(F.sum("n").alias("t")).collect()}  # a row for each feature and class
    first = next(iter(features))
    every = sum(t for (f, _), t in totals.items() if f == first) or 1
    classes = {c: math.log(t / every) for (f, c), t in sorted(totals.items(), key=lambda x: str(x[0])) if f == first}
    counts = dist.groupBy("feature", "value").agg(*(F.sum(F.when(F.col("cls") == c, F.col("n")).otherwise(0)).alias(f"n{n}") for n, c in enumerate(classes)))
    counts = counts.withColumn("v", F.count("*").over(Window.partitionBy("feature")))  # a row for each value
    out = df.select(*key, *(c.cast("string").alias(f"_v{i}") for i, c in enumerate(features.values())))
    for i, k in enumerate(features):
        lp = [F.log((F.col(f"n{n}") + 1) / (F.lit(totals.get((k, c), 0)) + F.col("v"))).alias(f"_s{i}_{n}") for n, c in enumerate(classes)]
        mine = counts.where(F.col("feature") == k).select(F.col("value").alias(f"_k{i}"), *lp)
        out = out.join(mine, F.col(f"_v{i}") == F.col(f"_k{i}"), "left")
    scores = [F.struct(F.round(sum((F.coalesce(F.col(f"_s{i}_{n}"), F.lit(0.0)) for i in range(len(features))), F.lit(p)), 9).alias("score"), F.lit(c).alias("cls")) for n, (c, p) in enumerate(classes.items())]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return out.select(*key, best.alias("x")).select(*key, F.col("x.cls").alias("cls"), F.col("x.score").alias("score"))


def best_split(df: DataFrame, feature: str, positive: Column, points: list[float]) -> DataFrame:
    """Gain of each binary split point; all candidates in one pass."""
    aggs = []
    for i, p in enumerate(points):
        left = F.col(feature) <= p
        aggs += [F.count_if(left).alias(f"n{i}"), F.count_if(left & positive).alias(f"p{i}")]
    one = df.agg(F.count("*").alias("all_n"), F.count_if(positive).alias("all_p"), *aggs)
    long = one.select("all_n", "all_p", F.explode(F.array(*(F.struct(F.lit(float(p)).alias("point"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p")) for i, p in enumerate(points)))).alias("x")).select("all_n", "all_p", "x.*")
    ent = lambda p: F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    n, p, N, P = (F.col(c) for c in ("n", "p", "all_n", "all_p"))
    gain = ent(P / N) - (n / N * ent(p / n) + (N - n) / N * ent((P - p) / (N - n)))
    return long.select("point", "n", gain.alias("gain"))


def grow_tree(df: DataFrame, cls: Column, candidates: dict[str, list[float]], depth: int) -> list[dict]:
    """Binary tree by entropy gain: one aggregation a level over all open nodes.  Paths are predicates."""
    paths, out = [[]], []
    for level in range(depth + 1):
        node = F.lit(None).cast("int")
        for i, path in enumerate(paths):
            cond = F.lit(True)
            for f, op, v in path:
                cond = cond & ((F.col(f) <= v) if op == "<=" else (F.col(f) > v))
            node = F.when(cond, i).otherwise(node)
        splits = [(f, p) for f, ps in candidates.items() for p in ps]
        aggs = [x for k, (f, p) in enumerate(splits) for x in (F.count_if(F.col(f) <= p).alias(f"n{k}"), F.count_if((F.col(f) <= p) & cls).alias(f"p{k}"))]
        rows = df.groupBy(node.alias("node")).agg(F.count("*").alias("N"), F.count_if(cls).alias("P"), *aggs).where("node is not null").collect()  # a row for each open node
        nxt = []
        for r in sorted(rows, key=lambda r: r["node"]):
            best = max(((_gain(r["N"], r["P"], r[f"n{k}"], r[f"p{k}"]), -k) for k in range(len(splits))), default=(0, 0))
            path = paths[r["node"]]
            if level == depth or best[0] <= 1e-12:
                out.append({"path": " and ".join(f"{f} {o} {v:g}" for f, o, v in path), "population": r["N"], "prob": r["P"] / r["N"]})
            else:
                f, p = splits[-best[1]]
                nxt += [[*path, (f, "<=", p)], [*path, (f, ">", p)]]
        paths = nxt
        if not paths:
            break
    return out


def _gain(N, P, n, p):
    def ent(a, b):
        return 0.0 if not b or a in (0, b) else -(a / b * math.log2(a / b) + (1 - a / b) * math.log2(1 - a / b))

    return ent(P, N) - (n / N * ent(p, n) + (N - n) / N * ent(P - p, N - n))


def kmeans_step(df: DataFrame, cols: list[str], centres: list[list[float]]) -> DataFrame:
    """Nearest centre of each row, then size, mean of each column and sum of squared distances."""
    d = [sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(cols, k, strict=True)), F.lit(0.0)) for k in centres]
    near = F.array_min(F.array(*(F.struct(x.alias("d"), F.lit(i).alias("k")) for i, x in enumerate(d))))
    a = df.select(*cols, near.alias("_near"))
    return a.groupBy(F.col("_near.k").alias("k")).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in cols), F.sum("_near.d").alias("sse"))


def kmeans(df: DataFrame, cols: list[str], centres: list[list[float]], rounds: int = 10) -> list[list[float]]:
    for _ in range(rounds):
        got = {r["k"]: [r[c] for c in cols] for r in kmeans_step(df, cols, centres).collect()}  # a row for each centre
        new = [got.get(i, c) for i, c in enumerate(centres)]
        if max(abs(a - b) for x, y in zip(new, centres) for a, b in zip(x, y)) < 1e-9:
            break
        centres = new
    return centres


def logistic_gradient(df: DataFrame, cols: list[str], y: Column, coef: list[float]) -> DataFrame:
    """Mean gradient of the log likelihood; coef[0] is the intercept."""
    z = sum((F.col(c) * w for c, w in zip(cols, coef[1:], strict=True)), F.lit(coef[0]))
    e = y - 1 / (1 + F.exp(-z))
    return df.agg(F.avg(e).alias("g0"), *(F.avg(e * F.col(c)).alias(f"g{i + 1}") for i, c in enumerate(cols)))


def fisher(df: DataFrame, x: str, positive: Column) -> DataFrame:
    g = df.agg(*(f(F.when(c, F.col(x))).alias(k + s) for s, c in (("0", ~positive), ("1", positive)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))))
    n0, n1 = F.col("n0"), F.col("n1")
    var = (n0 * F.col("v0") + n1 * F.col("v1")) / (n0 + n1)
    lo = F.log(n0 / n1)
    return g.select(var.alias("pooled_variance"), lo.alias("log_odds"), ((F.col("m0") + F.col("m1")) / 2 - lo * var / (F.col("m0") - F.col("m1"))).alias("boundary"))


def majority(votes: list[Column]) -> Column:
    return sum((v.cast("int") for v in votes), F.lit(0)) * 2 > len(votes)


def cost_decision(p: Column, cost_fp: float, cost_fn: float) -> Column:
    """1 where the expected cost of saying no exceeds that of saying yes."""
    return (p * cost_fn > (1 - p) * cost_fp).cast("int")


def arbitrate(positive: Column, negative: Column, cost_fn: float, cost_fp: float, classes: tuple[str, str] = ("N", "P")) -> Column:
    """The class of least expected cost, ties to the first: a negative answer costs cost_fn * positive + negative, a positive one cost_fp * negative + positive."""
    return F.when(cost_fp * negative + positive < cost_fn * positive + negative, classes[1]).otherwise(classes[0])


def cost_threshold(percent: Column, cost_fn: float, cost_fp: float, classes: tuple[str, str] = ("N", "P")) -> Column:
    """The same by a threshold on a percentage: positive above 100 * cost_fp / (cost_fp + cost_fn), in whole numbers."""
    return F.when(percent > (cost_fp * 100) // (cost_fp + cost_fn), classes[1]).otherwise(classes[0])
