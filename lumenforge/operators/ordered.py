"""Order over a whole table without one task that sorts it.

Cut points come from approximate quantiles (a bounded array); rows between two cut points form
a bucket, a window runs within each bucket, and the totals of earlier buckets, a row for each
bucket, are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, MOST, ROWS = 24, 256, 1_000_000


def bucket_of(df: DataFrame, col: str, least: int = LEAST, most: int = MOST, rows: int = ROWS) -> Column:
    """Number of the bucket of a numeric column's value; nulls are bucket 0.

    About ``rows`` rows a bucket, between ``least`` and ``most`` buckets.  Count and cut points are
    one row of the driver; the bucket is found by halving, in generated code.
    """
    got = df.agg(F.count(col).alias("n"), F.percentile_approx(col, [i / most for i in range(1, most)], 10 * most).alias("c")).first()
    want = min(most, max(least, -(-got["n"] // rows)))
    cuts = sorted({c for i, c in enumerate(got["c"] or [], 1) if i * want // most != (i - 1) * want // most})

    def halved(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) > cuts[mid], halved(mid + 1, hi)).otherwise(halved(lo, mid))

    return halved(0, len(cuts))


def running(df: DataFrame, order: str, sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds running sums over distinct values of ``order``, ascending and inclusive, of each group ``by`` itself.

    df has one row for each group and value of ``order`` (aggregate before).
    """
    keys = by or []
    d = df.withColumn("_b", bucket_of(df, order)).withColumns({f"_v{i}": c for i, c in enumerate(sums.values())})
    w = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tot = d.groupBy(*keys, "_b").agg(*(F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    tot = tot.select(*keys, "_b", *(F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_p{i}") for i in range(len(sums))))
    d = d.withColumns({f"_r{i}": F.sum(f"_v{i}").over(w) for i in range(len(sums))}).join(tot if keys else F.broadcast(tot), [*keys, "_b"])
    out = d.withColumns({name: F.col(f"_r{i}") + F.col(f"_p{i}") for i, name in enumerate(sums)})
    return out.drop("_b", *(f"_{k}{i}" for k in "vrp" for i in range(len(sums))))


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """by..., and a column for each of ``shares``: exact quantiles, between two values by distance; one row without ``by``.

    From running counts of distinct values in buckets, so no task holds all values of the column or of a group.
    """
    keys = by or []
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    c = running(c, "_x", {"_c": F.col("_n")}, keys)
    total = c.groupBy(*keys).agg(F.sum("_n").alias("_t"))
    c = c.join(total, keys) if keys else c.crossJoin(F.broadcast(total))
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_t") - 1)
        low, high = F.min(F.when(F.col("_c") > F.floor(at), F.col("_x"))), F.min(F.when(F.col("_c") > F.ceil(at), F.col("_x")))
        rest = F.max(at - F.floor(at))
        out.append(((1 - rest) * low + rest * high).alias(name))
    return c.groupBy(*keys).agg(*out)


def with_next(df: DataFrame, order: str, out: str) -> DataFrame:
    """Adds the next distinct value of ``order`` (null at the end); df has one row for each value."""
    d = df.withColumn("_b", bucket_of(df, order))
    firsts = d.groupBy("_b").agg(F.min(order).alias("_f"))
    later = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select("_b", F.min("_f").over(later).alias("_n"))
    own = F.lead(order).over(Window.partitionBy("_b").orderBy(order))
    return d.withColumn("_l", own).join(F.broadcast(firsts), "_b").withColumn(out, F.coalesce("_l", "_n")).drop("_b", "_l", "_n")


def average_ranks(df: DataFrame, value: str, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Average rank of each row's value over the whole table, ties sharing theirs."""
    counts = running(df.groupBy(value).agg(F.count("*").alias("_n")), value, {"_c": F.col("_n")})
    ranks = counts.select(F.col(value).alias("_k"), (F.col("_c") - (F.col("_n") - 1) / 2.0).alias(rank), F.col("_n").alias(f"{rank}_ties"))
    return df.join(ranks, df[value] == ranks["_k"]).drop("_k")


def dense_index(df: DataFrame, text: str, prefix: int = 2) -> DataFrame:
    """Adds ``idx``: the place, from 0, of a string among distinct ones.  Strings are ordered within their prefix alone."""
    d = df.withColumn("_p", F.substring(text, 1, prefix))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(text)) - 1
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each prefix
    start = d.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return d.withColumn("_i", own).join(start, "_p").withColumn("idx", (F.col("_s") + F.col("_i")).cast("int")).drop("_p", "_i", "_s")


def _apart(df: DataFrame, col: str) -> Column:
    """Number of the bucket of a column's value, as ``bucket_of``; a value that is a cut point has a bucket, of odd number, to itself.

    So a bucket of even number has few rows, however often a single value stands in the column.
    """
    got = df.agg(F.count(col).alias("n"), F.percentile_approx(col, [i / MOST for i in range(1, MOST)], 10 * MOST).alias("c")).first()
    want = min(MOST, max(LEAST, -(-got["n"] // ROWS)))
    cuts = sorted({c for i, c in enumerate(got["c"] or [], 1) if i * want // MOST != (i - 1) * want // MOST})

    def halved(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.when(F.col(col) == cuts[lo], 2 * lo + 1).otherwise(2 * lo) if lo < len(cuts) else F.lit(2 * lo)
        mid = (lo + hi) // 2
        return F.when(F.col(col) > cuts[mid], halved(mid + 1, hi)).otherwise(halved(lo, mid))

    return halved(0, len(cuts))


def _inversions(cells: DataFrame, bucket: str, first: str, second: str) -> DataFrame:
    """x: pairs that ``first`` and ``second`` order differently, within each bucket, times their counts n.  A bucket is sorted in one task."""

    def run(t: pa.Table) -> pa.Table:
        x, y, n = (t.column(c).to_numpy() for c in ("_x", "_y", "n"))
        o = np.lexsort((y, x))  # rows that are tied in x come in the order of y, so none of them counts
        code, n = np.unique(y, return_inverse=True)[1][o], n[o]
        total = 0
        for level in reversed(range(int(code.max()).bit_length())):
            # codes that share the bits above stand together, in the order of x; they differ first at this bit
            above, one = code >> (level + 1), (code >> level & 1).astype(bool)
            ones = np.cumsum(np.where(one, n, 0))
            starts = np.nonzero(np.r_[True, above[1:] != above[:-1]])[0]
            before = np.repeat(np.r_[0, ones][starts], np.diff(np.r_[starts, len(code)]))
            total += float((n * (ones - before))[~one].sum(dtype=float))
            o = np.argsort(code >> level, kind="stable")
            code, n = code[o], n[o]
        return pa.table({"x": [float(total)]})

    d = cells.select(F.col(bucket).alias("_k"), F.col(first).cast("double").alias("_x"), F.col(second).cast("double").alias("_y"), "n")
    return d.groupBy("_k").applyInArrow(run, "x double")


def discordant(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and pairs of rows tied in a, in b and in both, and pairs that a and b order differently.

    Such a pair stands in one bucket of a, or else in one bucket of b, or in two of each.  The first two kinds are
    counted by sorting a bucket, the third from the counts of buckets of a and b; no pair is formed, and a row
    is sent once for each kind.  Buckets that hold one value have no pair of their kind.
    """
    d = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    cells = d.groupBy("a", "b").agg(F.count("*").alias("n"))
    ka, kb = _apart(d, "a"), _apart(d, "b")
    own = _inversions(cells.select("*", ka.alias("_k")).where("_k % 2 = 0"), "_k", "a", "b")
    other = _inversions(cells.select("*", ka.alias("_a"), kb.alias("_k")).where("_k % 2 = 0"), "_k", "_a", "b")
    counts = d.groupBy(ka.alias("_a"), kb.alias("_b")).agg(F.count("*").cast("double").alias("n"))  # a row for each two buckets

    def across(batches):
        m = np.zeros((2 * MOST + 2, 2 * MOST + 2))
        for t in batches:
            m[t.column("_a").to_numpy(), t.column("_b").to_numpy()] = t.column("n").to_numpy()
        over = np.zeros_like(m)  # of lesser a and greater b
        over[1:, :-1] = np.cumsum(np.cumsum(m, 0)[:, ::-1], 1)[:-1, ::-1][:, 1:]
        yield pa.RecordBatch.from_pydict({"x": [float((m * over).sum())]})

    wrong = own.unionAll(other).unionAll(counts.coalesce(1).mapInArrow(across, "x double")).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("discordant"))
    pairs = lambda c: F.sum((F.col(c) * (F.col(c) - 1) / 2).cast("double"))
    ties = lambda k: d.groupBy(k).agg(F.count("*").alias("n")).agg(F.coalesce(pairs("n"), F.lit(0.0)).alias(f"tied_{k}"))
    both = cells.agg(F.sum("n").cast("double").alias("n"), F.coalesce(pairs("n"), F.lit(0.0)).alias("tied_both"))
    return both.crossJoin(F.broadcast(ties("a"))).crossJoin(F.broadcast(ties("b"))).crossJoin(F.broadcast(wrong))  # one row each
