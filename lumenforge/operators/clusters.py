"""k-means over groups with numeric and categorical columns, and starts in proportion to squared distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .bandits import uniform


def _gap(numeric: list[str], categorical: list[str], c: Column, scale: dict[str, float]) -> Column:
    """Mean squared distance of a row to a centre: scaled differences of numbers, 0 or 1 for categories."""
    parts = [F.pow((F.col(n) - c[n]) / scale.get(n, 1.0), F.lit(2.0)) for n in numeric] + [(F.col(n) != c[n]).cast("double") for n in categorical]
    return sum(parts, F.lit(0.0)) / len(parts)


def cluster_round(df: DataFrame, group: str, numeric: list[str], categorical: list[str], centres: DataFrame, scale: dict[str, float] | None = None, tolerance: float = 1e-9) -> DataFrame:
    """One round for all groups: group, k, n, the new centre (means and modes), error (mean squared distance), movement, active.

    centres: group, k, numeric, categorical; those of a group meet each of its rows as one array.  A centre without
    rows stays.  A group is active while one of its centres moves by more than ``tolerance``.
    """
    scale, cols = scale or {}, [*numeric, *categorical]
    held = centres.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("k", *cols))).alias("_c"))  # as many as a group has clusters
    near = F.array_min(F.transform("_c", lambda c: F.struct(_gap(numeric, categorical, c, scale).alias("d"), c["k"].alias("k"))))
    met = df.join(held, group).select(group, *cols, near.alias("_x")).select(group, *cols, F.col("_x.k").alias("k"), F.col("_x.d").alias("_d"))
    new = met.groupBy(group, "k").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in numeric), *(F.mode(c, True).alias(c) for c in categorical), F.avg("_d").alias("error"))
    old = centres.select(group, "k", F.struct(*cols).alias("_old"))
    x = old.join(new, [group, "k"], "left").select(group, "k", F.coalesce("n", F.lit(0)).alias("n"), *(F.coalesce(F.col(c), F.col(f"_old.{c}")).alias(c) for c in cols), F.coalesce("error", F.lit(0.0)).alias("error"), "_old")
    x = x.withColumn("movement", F.sqrt(_gap(numeric, categorical, F.col("_old"), scale))).drop("_old")
    moved = x.groupBy(group).agg((F.max("movement") > tolerance).alias("active"))
    return x.join(moved, group)


def cluster_groups(df: DataFrame, group: str, numeric: list[str], categorical: list[str], centres: DataFrame, rounds: int = 10, **options) -> DataFrame:
    """Rounds until no group is active; only rows of active groups are read again, each round's centres are stored."""
    settled, cols = None, [group, "k", *numeric, *categorical]
    for _ in range(rounds):
        got = stored(cluster_round(df, group, numeric, categorical, centres, **options), "centres")
        still = got.where(~F.col("active"))
        settled = still if settled is None else settled.unionByName(still)
        got = got.where("active")
        if got.isEmpty():
            return settled
        centres = got.select(*cols)
        df = df.join(centres.select(group).distinct(), group, "left_semi")
    return settled.unionByName(got)


def first_centres(df: DataFrame, group: str, key: str, cols: list[str], k: int, seed: int = 1) -> DataFrame:
    """The k rows of each group of least hash, numbered from 0."""
    w = Window.partitionBy(group).orderBy(uniform(seed, F.col(key)))
    return df.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < k).select(group, "k", *cols)


def spread_starts(df: DataFrame, key: str, cols: list[str], k: int, seed: int = 1) -> list[list[float]]:
    """k starts: the row of least hash, then rows drawn with chances in proportion to squared distance from the starts so far.

    A draw is one pass: the row of greatest ln(u) / d^2, u from a hash of the key.
    """
    out: list[list[float]] = []
    for i in range(k):
        u = uniform(seed + i, F.col(key))
        if out:
            gaps = [sum((F.pow(F.col(c) - v, F.lit(2.0)) for c, v in zip(cols, s, strict=True)), F.lit(0.0)) for s in out]
            d = F.least(*gaps) if len(gaps) > 1 else gaps[0]
            best = F.max_by(F.struct(*cols), F.struct((F.log(u) / d).alias("x"), key))
            r = df.where(d > 0).agg(best.alias("r")).first()["r"]
        else:
            r = df.agg(F.min_by(F.struct(*cols), F.struct(u.alias("u"), key)).alias("r")).first()["r"]
        if r is None:
            break
        out.append([float(r[c]) for c in cols])
    return out
