"""Distances, pair joins and neighbours.

Pairs are joined within blocks: a grouping column, a shared token, or an assigned cell; a full pair
join exists only against a query set that the caller bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; one pass for the ranges."""
    r = df.agg(*(F.min(c).alias(f"_l{i}") for i, c in enumerate(cols)), *(F.max(c).alias(f"_h{i}") for i, c in enumerate(cols)))
    return df.crossJoin(F.broadcast(r)).select(key, *((F.col(c) - F.col(f"_l{i}")) / (F.col(f"_h{i}") - F.col(f"_l{i}")) for i, c in enumerate(cols))).toDF(key, *cols)


def euclid(a: str, b: str, cols: list[str]) -> Column:
    return F.sqrt(sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2.0) for c in cols), F.lit(0.0)) / len(cols))


def grouped_pairs(df: DataFrame, key: str, group: str, cols: list[str]) -> DataFrame:
    """All unordered pairs within each group, with their distance."""
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{key}").alias("k1"), F.col(f"b.{key}").alias("k2"), euclid("a", "b", cols).alias("dist"))


def against(queries: DataFrame, rows: DataFrame, key: str, dist: Column, only: Column | None = None, block: int = 4096) -> DataFrame:
    """Distance of each row of a query set to all other rows (those where ``only`` holds, if given).

    A query set of at most ``block`` rows is broadcast.  A greater one is cut into blocks, and so
    are the rows; each pair of blocks meets in one task.
    """
    cond = F.col(f"a.{key}") != F.col(f"b.{key}")
    cond = cond if only is None else cond & only
    blocks = -(-queries.count() // block)
    if blocks <= 1:
        a, b = F.broadcast(queries.alias("a")), rows.alias("b")
    else:
        own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        a = queries.select("*", own.alias("_q"), each.alias("_r")).alias("a")
        b = rows.select("*", own.alias("_r"), each.alias("_q")).alias("b")
        cond = (F.col("a._q") == F.col("b._q")) & (F.col("a._r") == F.col("b._r")) & cond
    return a.join(b, cond).select(F.col(f"a.{key}").alias("src"), F.col(f"b.{key}").alias("dst"), dist.alias("dist"))


NEAR = "src long, dst long, dist double"


def _best(qk: np.ndarray, qv: np.ndarray, qg: list, rk: np.ndarray, rv: np.ndarray, rg: list, k: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its k nearest rows (of its group, not itself), ties by key; rows so many at a time."""
    if qv.shape[1] >= 8 and len(qk) and len(rk):
        return _best_by_products(qk, qv, qg, rk, rv, rg, k, mean)
    held_d, held_k = np.full((len(qk), k), np.inf), np.full((len(qk), k), np.iinfo(np.int64).max)
    step = max(1, (1 << 22) // max(1, len(qk)))
    codes = {g: i for i, g in enumerate(dict.fromkeys([*qg, *rg]))}
    qc, rc = np.array([codes[g] for g in qg], np.int64), np.array([codes[g] for g in rg], np.int64)
    for at in range(0, len(rk), step):
        part, keys = rv[at : at + step], rk[at : at + step]
        d = np.zeros((len(qk), len(keys)))
        for c in range(qv.shape[1]):
            gap = qv[:, c, None] - part[None, :, c]
            d += gap * gap
        d = np.sqrt(d / qv.shape[1] if mean else d)
        d[(qk[:, None] == keys[None]) | (qc[:, None] != rc[None, at : at + step])] = np.inf
        all_d, all_k = np.hstack([held_d, d]), np.hstack([held_k, np.broadcast_to(keys, d.shape)])
        if all_d.shape[1] > 4 * k:  # what lies beyond the k-th distance can't stay
            cut = np.partition(all_d, k - 1, axis=1)[:, k - 1]
            few = int((all_d <= cut[:, None]).sum(1).max())
            near = np.argpartition(all_d, min(few, all_d.shape[1]) - 1, axis=1)[:, :few]
            all_d, all_k = np.take_along_axis(all_d, near, 1), np.take_along_axis(all_k, near, 1)
        order = np.lexsort((all_k, all_d), axis=1)[:, :k]
        held_d, held_k = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_k, order, 1)
    q, j = np.nonzero(np.isfinite(held_d))
    return qk[q], held_k[q, j], held_d[q, j]


def _best_by_products(qk: np.ndarray, qv: np.ndarray, qg: list, rk: np.ndarray, rv: np.ndarray, rg: list, k: int, mean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_best`` gives, for longer vectors: a matrix product finds the pairs that may be among the nearest, with
    room for its rounding, and only their distances are summed column by column."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    whole_q, whole_r = np.isfinite(qv).all(1), np.isfinite(rv).all(1)
    if not (whole_q.all() and whole_r.all()):
        qk, qv, qg = qk[whole_q], qv[whole_q], [g for g, w in zip(qg, whole_q, strict=True) if w]
        rk, rv, rg = rk[whole_r], rv[whole_r], [g for g, w in zip(rg, whole_r, strict=True) if w]
    if not (len(qk) and len(rk)):
        return none
    codes = {g: i for i, g in enumerate(dict.fromkeys([*qg, *rg]))}
    qc, rc = np.array([codes[g] for g in qg], np.int64), np.array([codes[g] for g in rg], np.int64)
    qq, rr = (qv * qv).sum(1), (rv * rv).sum(1)
    slack = (qq + rr.max()) * 1e-11 + 1e-300
    bound = np.full(len(qk), np.inf)  # of the square
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # place of the query, key, distance
    step = max(4 * k, (1 << 22) // len(qk))
    for at in range(0, len(rk), step):
        part, keys = rv[at : at + step], rk[at : at + step]
        near = qv @ part.T
        near *= -2
        near += qq[:, None]
        near += rr[None, at : at + step]
        near[qk[:, None] == keys[None]] = np.inf
        if len(codes) > 1:
            near[qc[:, None] != rc[None, at : at + step]] = np.inf
        if not np.isfinite(bound).all() and len(keys) > k:
            bound = np.minimum(bound, np.partition(near, k - 1, axis=1)[:, k - 1] + slack)
        i, j = np.nonzero(near <= np.where(np.isfinite(bound), bound + slack, np.finfo(float).max)[:, None])
        d = np.zeros(len(i))
        for c in range(qv.shape[1]):
            gap = qv[i, c] - part[j, c]
            d += gap * gap
        d = np.sqrt(d / qv.shape[1] if mean else d)
        i, t, d = np.concatenate([held[0], i]), np.concatenate([held[1], keys[j]]), np.concatenate([held[2], d])
        o = np.lexsort((t, d, i))
        i, t, d = i[o], t[o], d[o]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == k - 1
        bound[i[last]] = np.minimum(bound[i[last]], d[last] ** 2 * (qv.shape[1] if mean else 1) * (1 + 1e-12) + slack[i[last]])
        held = i[place < k], t[place < k], d[place < k]
    return qk[held[0]], held[1], held[2]


def nearest_rows(queries: DataFrame, rows: DataFrame, k: int, mean: bool = True, block: int = 4096) -> DataFrame:
    """src, dst, dist, rank: the k nearest rows of each query, both (key long, v array of double, group).

    Each task keeps the k best of its rows for each query, so k rows a query and task are shuffled, not
    all distances.  A query set of at most ``block`` rows goes along with the function; a greater one is cut
    into blocks, as are the rows, and each pair of blocks meets in one task.  Only rows of a query's group
    count (null: one group).  mean: distances are root mean squares, else Euclidean.
    """
    cols = [F.col("key").cast("long").alias("key"), F.col("v").cast("array<double>").alias("v"), F.col("group").cast("string").alias("group")]
    queries, rows = queries.select(*cols), rows.select(*cols)
    blocks = -(-queries.count() // block)

    def arrays(table):
        v = table.column("v").combine_chunks()
        flat, n = v.flatten(), len(v)
        whole = v.null_count == 0 and n and len(flat) % n == 0
        x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if whole else np.array(v.to_pylist(), float).reshape(n, -1)
        return table.column("key").to_numpy(), x, table.column("group").to_pylist()

    def found(q, r):
        s, t, d = _best(*q, *r, k, mean)
        return pa.table([pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(d, pa.float64())], names=["src", "dst", "dist"])

    if blocks <= 1:
        got = queries.collect()  # at most ``block`` rows
        if not got:
            return queries.sparkSession.createDataFrame([], NEAR + ", rank int")
        q = np.array([r["key"] for r in got], np.int64), np.array([r["v"] for r in got], float), [r["group"] for r in got]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield from found(q, arrays(pa.Table.from_batches([b]))).to_batches()

        part = rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism), "key").mapInArrow(run, NEAR)
    else:
        own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        a = queries.select("*", own.alias("_q"), each.alias("_r")).groupBy("_q", "_r")
        b = rows.select("*", own.alias("_r"), each.alias("_q")).groupBy("_q", "_r")
        none = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["src", "dst", "dist"])
        part = a.cogroup(b).applyInArrow(lambda x, y: found(arrays(x), arrays(y)) if x.num_rows and y.num_rows else none, NEAR)
    return nearest(part, k)


def neighbours_in_order(df: DataFrame, key: str, by: list[str], order: str, k: int) -> DataFrame:
    """Each row with the k rows that follow it in an order within its block: candidate neighbours by one sort."""
    w = Window.partitionBy(*by).orderBy(order, key)
    near = F.array(*(F.lead(key, j).over(w) for j in range(1, k + 1)))
    return df.select(F.col(key).alias("src"), near.alias("n")).select("src", F.explode("n").alias("dst")).where("dst is not null")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("src").orderBy("dist", "dst")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vote(neighbours: DataFrame, weight: Column | None = None) -> DataFrame:
    """Class of the greatest (weighted) count; ties by the least class."""
    s = neighbours.groupBy("src", "cls").agg(F.sum(weight if weight is not None else F.lit(1)).alias("w"))
    return s.groupBy("src").agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("cls")).alias("m"))).alias("x")).select("src", (-F.col("x.m")).alias("cls"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def l2(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def token_sets(df: DataFrame, key: str, text: str, pattern: str = "[^a-z]+") -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower(F.col(text)), pattern), lambda x: x != ""))
    return df.select(F.col(key).alias("k"), words.alias("w"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard similarity of pairs that share a token, by an inverted index."""
    x = a.select(F.col("k").alias("k1"), F.size("w").alias("n1"), F.explode("w").alias("t"))
    y = b.select(F.col("k").alias("k2"), F.size("w").alias("n2"), F.explode("w").alias("t"))
    p = x.join(y, "t").groupBy("k1", "k2", "n1", "n2").agg(F.count("*").alias("c"))
    return p.select("k1", "k2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("jaccard"))


def class_weighted(neighbours: DataFrame, posterior: DataFrame) -> DataFrame:
    """Neighbours with the probability of their own class: posterior is key, cls, p."""
    return neighbours.join(posterior.select(F.col("key").alias("dst"), "cls", "p"), ["dst", "cls"])


def term_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """k1, k2, cosine of term counts (k, term, n), over pairs that share a term."""
    norm = lambda d, k: d.groupBy(F.col("k").alias(k)).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias(f"norm_{k}"))
    p = a.select(F.col("k").alias("k1"), "term", F.col("n").alias("n1")).join(b.select(F.col("k").alias("k2"), "term", F.col("n").alias("n2")), "term")
    p = p.groupBy("k1", "k2").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    return p.join(norm(a, "k1"), "k1").join(norm(b, "k2"), "k2").select("k1", "k2", (F.col("dot") / (F.col("norm_k1") * F.col("norm_k2"))).alias("cosine"))


def kernel(dist: Column, kind: str, width: float = 1.0) -> Column:
    """Weight of a neighbour: none, linearMultiplicative, linearAdditive, gaussian, inverse."""
    return {"none": F.lit(1.0), "linearMultiplicative": 1 / F.greatest(dist, F.lit(1e-9)), "linearAdditive": F.greatest(F.lit(0.0), width - dist), "gaussian": F.exp(-dist * dist / (2 * width * width)), "inverse": 1 / (1 + dist)}[kind]


def regress(neighbours: DataFrame, y: str, how: str = "average") -> DataFrame:
    """Prediction of each source from its neighbours: average, median, or a line of y over distance at 0."""
    g = neighbours.groupBy("src")
    if how == "linear":
        return g.agg(F.coalesce(F.regr_intercept(F.col(y), F.col("dist")), F.avg(y)).alias("prediction"))
    return g.agg({"average": F.avg, "median": F.median}[how](y).alias("prediction"))


def relief(neighbours: DataFrame, rows: DataFrame, key: str, cls: str, cols: list[str]) -> DataFrame:
    """Relevance of each column: mean distance to misses less that to hits."""
    n = neighbours.join(rows.alias("a"), F.col("src") == F.col(f"a.{key}")).join(rows.alias("b"), F.col("dst") == F.col(f"b.{key}"))
    sign = F.when(F.col(f"a.{cls}") == F.col(f"b.{cls}"), -1.0).otherwise(1.0)
    one = n.agg(*((F.sum(sign * F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))) / F.count("*")).alias(c) for c in cols))
    return one.unpivot([], cols, "feature", "relevance")
