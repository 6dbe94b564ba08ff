"""Outliers: local outlier factor, Mahalanobis distance, isolation forest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bandits import uniform


def local_outlier_factor(pairs: DataFrame, k: int) -> DataFrame:
    """src, lof, from distances of pairs in both directions (src, dst, dist)."""
    w = Window.partitionBy("src").orderBy("dist", "dst")
    near = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", "dst", "dist")
    reach = near.groupBy("src").agg(F.max("dist").alias("kd"))
    d = near.join(reach.withColumnsRenamed({"src": "dst", "kd": "kd2"}), "dst").select("src", "dst", F.greatest("dist", "kd2").alias("r"))
    density = d.groupBy("src").agg((1 / F.greatest(F.avg("r"), F.lit(1e-12))).alias("lrd"))
    other = density.withColumnsRenamed({"src": "dst", "lrd": "lrd2"})
    x = near.join(other, "dst").groupBy("src").agg(F.avg("lrd2").alias("m"))
    return x.join(density, "src").select("src", (F.col("m") / F.col("lrd")).alias("lof"))


def _moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    k = len(cols)
    r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)), *(F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    return np.array([r[f"m{i}"] for i in range(k)]), np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])


def _distance(cols: list[str], mean: np.ndarray, cov: np.ndarray):
    inv = np.linalg.pinv(cov)
    z = [F.col(c) - float(m) for c, m in zip(cols, mean, strict=True)]
    return F.sqrt(F.greatest(F.lit(0.0), sum((z[i] * z[j] * float(inv[i, j]) for i in range(len(z)) for j in range(len(z))), F.lit(0.0))))


def mahalanobis(df: DataFrame, cols: list[str], robust: float | None = None, rounds: int = 10) -> DataFrame:
    """Adds ``distance``.  robust: share of rows, those nearest, that mean and covariance are taken of, again and again."""
    mean, cov = _moments(df, cols)
    for _ in range(rounds if robust else 0):
        d = df.withColumn("_d", _distance(cols, mean, cov))
        cut = d.agg(F.percentile_approx("_d", robust, 10_000).alias("c")).first()["c"]
        new = _moments(d.where(F.col("_d") <= cut), cols)
        done = np.allclose(new[0], mean, rtol=1e-6)
        mean, cov = new
        if done:
            break
    return df.withColumn("distance", _distance(cols, mean, cov))


def isolation_forest(df: DataFrame, key: str, cols: list[str], trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """key, score (near 1: easily parted from the rest).  Trees are grown on at most trees * sample rows, all rows are scored."""
    n = df.count()
    share = min(1.0, 1.5 * trees * sample / max(1, n))
    rows = df.where(uniform(seed, F.col(key)) < share).select(key, *cols).limit(2 * trees * sample).toPandas().sort_values(key)[cols].to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(rows))
    depth = int(np.ceil(np.log2(max(2, size))))

    def path_bonus(k: int) -> float:
        return 0.0 if k <= 1 else 2 * (np.log(k - 1) + 0.5772156649) - 2 * (k - 1) / k if k > 2 else 1.0

    def grow(x: np.ndarray, level: int):
        lo, hi = x.min(0), x.max(0)
        live = np.flatnonzero(hi > lo)
        if level >= depth or len(x) <= 1 or not len(live):
            return level + path_bonus(len(x))
        c = int(rng.choice(live))
        at = float(rng.uniform(lo[c], hi[c]))
        left = x[:, c] < at
        return c, at, grow(x[left], level + 1), grow(x[~left], level + 1)

    forest = [grow(rows[rng.choice(len(rows), size, replace=False)], 0) for _ in range(trees)] if len(rows) else []
    norm = path_bonus(size) or 1.0

    def depth_of(node, x, at, out):
        if not isinstance(node, tuple):
            out[at] += node
            return
        c, cut, left, right = node
        go = x[at, c] < cut
        for part, side in ((at[go], left), (at[~go], right)):
            if len(part):
                depth_of(side, x, part, out)

    def run(it):
        for b in it:
            x, total = b[cols].to_numpy(float), np.zeros(len(b))
            for t in forest:
                depth_of(t, x, np.arange(len(b)), total)
            yield pd.DataFrame({key: b[key], "score": 2.0 ** (-total / max(1, len(forest)) / norm)})

    return df.select(key, *cols).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")
