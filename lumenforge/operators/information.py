"""Entropy and mutual information over tables of counts, and feature scores built on them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy_of(counts: DataFrame, n: str = "n") -> DataFrame:
    t = counts.agg(F.sum(n).alias("_t"))
    p = F.col(n) / F.col("_t")
    return counts.crossJoin(F.broadcast(t)).agg(F.sum(-p * F.log(p)).alias("h"))  # t: one row


def joint(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.groupBy(*(c.alias(k) for k, c in cols.items())).agg(F.count("*").alias("n"))


def information_table(df: DataFrame, features: dict[str, Column], target: Column) -> DataFrame:
    """For each feature and pair: mutual information with the target, between the two, and joint
    entropies.  All count families come from one grouping-sets aggregation over the rows.

    Rows: a, b (null for one feature), h (entropy of the features), mi (with the target),
    hy (joint entropy with the target).
    """
    names = list(features)
    base = df.select(*(c.cast("string").alias(k) for k, c in features.items()), target.cast("string").alias("_y")).groupBy(*names, "_y").agg(F.count("*").alias("n"))
    sets = [(x,) for x in names] + list(combinations(names, 2))
    parts = F.explode(F.array(*(F.struct(F.lit(s[0]).alias("a"), F.lit(s[1] if len(s) > 1 else None).cast("string").alias("b"), F.concat_ws("\x01", *s).alias("v")) for s in sets)))
    long = base.select(parts.alias("x"), "_y", "n").select("x.a", "x.b", "x.v", "_y", "n")
    xy = long.groupBy("a", "b", "v", "_y").agg(F.sum("n").alias("n"))
    x = xy.groupBy("a", "b", "v").agg(F.sum("n").alias("n"))
    y = base.groupBy("_y").agg(F.sum("n").alias("n"))
    h = lambda d, by: d.groupBy(*by).agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    hx = h(x, ["a", "b"])
    hxy = h(xy, ["a", "b"]).withColumnsRenamed({"h": "hxy", "a": "a2", "b": "b2"})
    hy = y.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("hy"))
    j = hx.join(hxy, (F.col("a") == F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))).crossJoin(F.broadcast(hy))
    return j.select("a", "b", "h", (F.col("h") + F.col("hy") - F.col("hxy")).alias("mi"), "hxy")


def feature_scores(table: DataFrame, algorithm: str, beta: float = 1.0) -> list[tuple[str, float]]:
    """Greedy order of features with scores: mim, mifs, jmi, disr, mrmr, cmim, icap.

    The table has a row for each feature and pair of features; the loop never reads the data again.
    """
    rows = table.collect()
    mi = {r["a"]: r["mi"] for r in rows if r["b"] is None}
    h1 = {r["a"]: r["h"] for r in rows if r["b"] is None}
    pair = {}
    for r in rows:
        if r["b"] is not None:
            pair[r["a"], r["b"]] = pair[r["b"], r["a"]] = r
    one = {r["a"]: r for r in rows if r["b"] is None}
    between = lambda f, s: h1[f] + h1[s] - pair[f, s]["h"]
    target = lambda f: one[f]["mi"] - one[f]["h"] + one[f]["hxy"]  # noqa: E731  entropy of the target
    given = lambda f, s: one[f]["hxy"] + one[s]["hxy"] - pair[f, s]["hxy"] - target(f)
    if algorithm == "mim":
        return sorted(mi.items(), key=lambda x: (-x[1], x[0]))
    out: list[tuple[str, float]] = []
    rest = set(mi)
    while rest:
        chosen = [f for f, _ in out]

        def score(f: str) -> float:
            if not chosen:
                return mi[f]
            if algorithm == "mifs":
                return mi[f] - beta * sum(between(f, s) for s in chosen)
            if algorithm == "mrmr":
                return mi[f] - sum(between(f, s) for s in chosen) / len(chosen)
            if algorithm == "jmi":
                return sum(pair[f, s]["mi"] for s in chosen)
            if algorithm == "disr":
                return sum(pair[f, s]["mi"] / pair[f, s]["hxy"] for s in chosen)
            if algorithm == "cmim":
                return mi[f] - max(between(f, s) - given(f, s) for s in chosen)
            if algorithm == "icap":
                return mi[f] - sum(max(0.0, between(f, s) - given(f, s)) for s in chosen)
            raise ValueError(algorithm)

        best = max(sorted(rest), key=lambda f: round(score(f), 12))
        out.append((best, score(best)))
        rest.discard(best)
    return out


def split_stats(df: DataFrame, segment: Column, positive: Column) -> DataFrame:
    """Entropy (bits), gini, Hellinger distance, class confidence, gain and gain ratio of one split, binary class."""
    g = df.groupBy(segment.alias("s")).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    t = g.agg(F.sum("n").alias("all_n"), F.sum("p").alias("all_p"))
    x = g.crossJoin(F.broadcast(t))
    ent = lambda p: F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(0.0)
    p, w = F.col("p") / F.col("n"), F.col("n") / F.col("all_n")
    tp, tn = F.col("p") / F.col("all_p"), (F.col("n") - F.col("p")) / (F.col("all_n") - F.col("all_p"))
    root = F.first(ent(F.col("all_p") / F.col("all_n")))
    out = x.agg(F.sum(w * ent(p)).alias("entropy"), F.sum(w * (1 - p * p - (1 - p) * (1 - p))).alias("gini"), F.sqrt(F.sum(F.pow(F.sqrt(tp) - F.sqrt(tn), 2.0))).alias("hellinger"), F.sum(w * ent(tp / (tp + tn))).alias("class_conf"), root.alias("root"), F.sum(-w * F.log2(w)).alias("split_info"))
    return out.select("entropy", "gini", "hellinger", "class_conf", (F.col("root") - F.col("entropy")).alias("gain"), ((F.col("root") - F.col("entropy")) / F.col("split_info")).alias("gain_ratio"))
