"""Markov models, sequences and hidden states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.col(key).alias("key"), F.lag(state).over(w).alias("src"), F.col(state).alias("dst"), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order))).where("src is not null")


def transition_counts(df: DataFrame, key: str, order: list[str], state: str, by: list[str] | None = None) -> DataFrame:
    p = pairs(df, key, order, state) if not by else None
    if p is None:
        w = Window.partitionBy(key).orderBy(*order)
        p = df.select(*by, F.lag(state).over(w).alias("src"), F.col(state).alias("dst")).where("src is not null")
    return p.groupBy(*(by or []), "src", "dst").agg(F.count("*").alias("n"))


def completed(counts: DataFrame, states: DataFrame) -> DataFrame:
    """All pairs of states, one added to each count.  states: a row for each state."""
    a, b = states.toDF("src"), states.toDF("dst")
    return a.crossJoin(F.broadcast(b)).join(counts, ["src", "dst"], "left").select("src", "dst", (F.coalesce("n", F.lit(0)) + 1).alias("n"))


def normalised(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(*(by or []), "src")
    return counts.select(*(by or []), "src", "dst", "n", (F.col("n") / F.sum("n").over(w)).alias("p"))


def log_odds(seq: DataFrame, model: DataFrame) -> DataFrame:
    """Sum over a key's transitions of ln(p_pos / p_neg).  model: src, dst, pos, neg (states squared rows)."""
    return seq.join(F.broadcast(model), ["src", "dst"]).groupBy("key").agg(F.sum(F.log(F.col("pos") / F.col("neg"))).alias("score"))


def rates(df: DataFrame, key: str, order: list[str], state: str, seconds: Column, unit: float = 86400.0) -> DataFrame:
    """Continuous-time rates: transitions from a state over the time spent in it, a unit of time."""
    w = Window.partitionBy(key).orderBy(*order)
    d = df.select(F.col(state).alias("src"), F.lead(state).over(w).alias("dst"), (F.lead(seconds).over(w) - seconds).alias("dt")).where("dst is not null")
    t = d.groupBy("src").agg(F.sum("dt").alias("time"))
    c = d.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(t), "src").select("src", "dst", "n", (F.col("n") * unit / F.col("time")).alias("rate"))


def dwell(rate: DataFrame, horizon: float, steps: int = 200) -> DataFrame:
    """Expected time in each state up to the horizon, by uniformisation, for each start state.

    The matrix has a row for each state and is worked on in one task.
    """

    def run(it):
        p = pd.concat(list(it))
        s = sorted(set(p.src) | set(p.dst))
        q = np.zeros((len(s), len(s)))
        for a, b, r in zip(p.src, p.dst, p.rate):
            q[s.index(a), s.index(b)] = r
        np.fill_diagonal(q, -q.sum(1))
        lam = max(1e-12, float((-np.diag(q)).max()))
        u = np.eye(len(s)) + q / lam
        x, total, term = np.eye(len(s)), np.zeros_like(q), np.exp(-lam * horizon)
        tail = 1 - term
        for k in range(steps):
            total += x * tail / lam
            x = x @ u
            term *= lam * horizon / (k + 1)
            tail -= term
        yield pd.DataFrame([(a, b, total[i, j]) for i, a in enumerate(s) for j, b in enumerate(s)], columns=["start", "state", "time"])

    return rate.select("src", "dst", "rate").coalesce(1).mapInPandas(run, "start string, state string, time double")


def ngrams(df: DataFrame, key: str, order: list[str], state: str, size: int) -> DataFrame:
    """Counts of all runs of 2..size states that end at each position."""
    w = Window.partitionBy(key).orderBy(*order)
    x = df.select(*(F.lag(state, j).over(w).alias(f"s{j}") for j in range(size - 1, -1, -1)))
    grams = F.array(*(F.when(F.col(f"s{n - 1}").isNotNull(), F.concat_ws(",", *(f"s{j}" for j in range(n - 1, -1, -1)))) for n in range(2, size + 1)))
    return x.select(F.explode(grams).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count("*").alias("n"))


def ordered_sequences(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    s = F.array_sort(F.collect_list(F.struct(*order, state)))
    return df.groupBy(key).agg(F.concat_ws(",", F.transform(s, lambda x: x[state])).alias("sequence"))


def join_candidates(seqs: DataFrame) -> DataFrame:
    """Sequences (arrays of k) that overlap in k-1 items joined into k+1."""
    a = seqs.select(F.col("seq").alias("x"), F.slice("seq", 2, 100).alias("tail"))
    b = seqs.select(F.col("seq").alias("y"), F.slice("seq", 1, F.size("seq") - 1).alias("head"))
    return a.join(b, a["tail"] == b["head"]).select(F.concat("x", F.slice("y", -1, 1)).alias("seq"))


def positional_clusters(df: DataFrame, key: str, ts: Column, span: float) -> DataFrame:
    """Runs of events whose gaps are at most span seconds."""
    w = Window.partitionBy("k").orderBy("t")
    d = df.select(F.col(key).alias("k"), ts.alias("t"))
    d = d.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(w) > span, F.lit(True)).cast("int"))
    return d.withColumn("c", F.sum("new").over(w)).groupBy("k", "c").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"))


def viterbi(seqs: DataFrame, states: list[str], start: list[float], trans: list[list[float]], emit: dict[str, list[float]]) -> DataFrame:
    """Most likely hidden states of each sequence (key, obs array)."""
    a, p = np.log(np.maximum(trans, 1e-300)), np.log(np.maximum(start, 1e-300))
    e = {k: np.log(np.maximum(v, 1e-300)) for k, v in emit.items()}
    flat = np.zeros(len(states))

    def run(it):
        for b in it:
            out = []
            for obs in b.obs:
                v, back = p + e.get(obs[0], flat), []
                for o in obs[1:]:
                    m = v[:, None] + a
                    back.append(m.argmax(0))
                    v = m.max(0) + e.get(o, flat)
                path = [int(v.argmax())]
                for k in reversed(back):
                    path.append(int(k[path[-1]]))
                out.append(",".join(states[i] for i in reversed(path)))
            yield pd.DataFrame({"key": b.key, "path": out})

    return seqs.mapInPandas(run, "key long, path string")
