"""Summaries, topics, embeddings and aggregated similarities of text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import sentences, tokens


def term_frequency_scores(df: DataFrame, key: str, text: str, normaliser: str = "linear") -> DataFrame:
    """Each sentence's sum of corpus counts of its words, over its length or the log of it."""
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    w = s.select(key, "pos", F.explode(tokens(F.col("sentence"))).alias("term"))
    c = w.groupBy("term").agg(F.count("*").alias("n"))
    x = w.join(c, "term").groupBy(key, "pos").agg(F.sum("n").alias("s"), F.count("*").alias("len"))
    by = F.col("len") if normaliser == "linear" else F.log(F.col("len") + 1)
    return x.select(key, "pos", (F.col("s") / by).alias("score"))


def top_sentences(scores: DataFrame, key: str, size: int) -> DataFrame:
    """The best sentences of each document, by place in it."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "pos")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size)


def _vectors(sents: list[str]) -> np.ndarray:
    words = [s.lower().split() for s in sents]
    at = {w: i for i, w in enumerate(sorted({w for x in words for w in x}))}
    m = np.zeros((len(sents), len(at)))
    for i, x in enumerate(words):
        for w in x:
            m[i, at[w]] += 1
    return m


def mmr(scores: np.ndarray, vectors: np.ndarray, size: int, weight: float = 0.7) -> list[int]:
    """Maximal marginal relevance: score less likeness to what is chosen."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    rel = scores / max(1e-12, np.abs(scores).max()) if len(scores) else scores
    out: list[int] = []
    while len(out) < min(size, len(rel)):
        red = (v @ v[out].T).max(1) if out else np.zeros(len(rel))
        x = np.round(weight * rel - (1 - weight) * red, 12)
        x[out] = -np.inf
        out.append(int(np.argmax(x)))
    return out


def _pick(kind: str, size: int, topics: int):
    def lsa(s):
        m = _vectors(s)
        u, sv, _ = np.linalg.svd(m, full_matrices=False)
        return _round_robin(np.abs(u[:, :topics] * sv[:topics]).T, size)

    def nmf(s):
        m = _vectors(s)
        rng = np.random.default_rng(1)
        k = max(1, min(topics, *m.shape)) if m.size else 1
        w, h = rng.random((m.shape[0], k)) + 0.1, rng.random((k, m.shape[1])) + 0.1
        for _ in range(60):
            h *= (w.T @ m) / np.maximum(w.T @ w @ h, 1e-9)
            w *= (m @ h.T) / np.maximum(w @ h @ h.T, 1e-9)
        return _round_robin(w.T, size)

    def diverse(s):
        m = _vectors(s)
        return mmr(m @ m.sum(0) / np.maximum(1, m.sum(1)), m, size)

    return {"lsa": lsa, "nmf": nmf, "mmr": diverse}[kind]


def _round_robin(topics: np.ndarray, size: int) -> list[int]:
    out: list[int] = []
    orders = [list(np.argsort(-np.round(t, 9), kind="stable")) for t in topics]
    n = topics.shape[1] if topics.ndim > 1 else 0
    while len(out) < min(size, n):
        for o in orders:
            nxt = next((int(i) for i in o if int(i) not in out), None)
            if nxt is not None and len(out) < size:
                out.append(nxt)
    return out


def summarise(df: DataFrame, key: str, text: str, kind: str, size: int = 3, topics: int = 2) -> DataFrame:
    """Places of the chosen sentences (lsa, nmf or mmr), document by document."""
    pick = _pick(kind, size, topics)

    def run(it):
        for b in it:
            rows = [(k, r, int(i)) for k, x in zip(b.k, b.s) if len(x) for r, i in enumerate(pick(list(x)))]
            yield pd.DataFrame(rows, columns=["k", "rank", "sentence"])

    return df.select(F.col(key).alias("k"), sentences(F.col(text)).alias("s")).mapInPandas(run, "k long, rank int, sentence int")


def topic_model(df: DataFrame, words: Column, topics: int = 4, rounds: int = 10, vocabulary: int = 1 << 16):
    """An LDA model, and the vectoriser that goes with it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    d = df.withColumn("_words", words).where(F.size("_words") > 0)
    return Pipeline(stages=[CountVectorizer(inputCol="_words", outputCol="_v", vocabSize=vocabulary), LDA(k=topics, maxIter=rounds, featuresCol="_v", seed=1)]).fit(d), d


def by_odds_ratio(shares: list[float], least: float) -> list[int]:
    """Indices by share until the odds fall below a part of those before."""
    order = sorted(range(len(shares)), key=lambda i: -shares[i])
    odds = lambda p: p / max(1e-12, 1 - p)
    out = order[:1]
    for a, b in zip(order, order[1:]):
        if odds(shares[a]) * least > odds(shares[b]):
            break
        out.append(b)
    return out


def word_vectors(df: DataFrame, words: Column, size: int = 16, least: int = 2, rounds: int = 1, task_words: int = 1 << 20):
    """A fitted Word2Vec and its rows.  A task trains on about ``task_words`` words; those of all tasks together are the whole input."""
    from pyspark.ml.feature import Word2Vec

    d = df.withColumn("_words", words).where(F.size("_words") > 0)
    parts = max(1, -(-(d.agg(F.sum(F.size("_words")).alias("n")).first()["n"] or 0) // task_words))
    return Word2Vec(vectorSize=size, minCount=least, maxIter=rounds, inputCol="_words", outputCol="vector", seed=1, numPartitions=parts).fit(d), d


def aggregate_pairs(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """From scores of all pairs of parts of two documents (a, b by document d1, d2): average, median, greatest, average of greatest, greatest of averages."""
    rows = pairs.groupBy("d1", "d2", a).agg(F.max(score).alias("top"), F.avg(score).alias("mean"))
    best = rows.groupBy("d1", "d2").agg(F.avg("top").alias("avg_of_max"), F.max("mean").alias("max_of_avg"))
    base = pairs.groupBy("d1", "d2").agg(F.avg(score).alias("average"), F.median(score).alias("median"), F.max(score).alias("greatest"))
    return base.join(best, ["d1", "d2"])


def aggregate_scores(scores: DataFrame, doc: str, score: str, how: str) -> DataFrame:
    """One score a document from those of its fragments: average, median or max."""
    f = {"average": F.avg, "median": F.median, "max": F.max}[how]
    return scores.groupBy(doc).agg(f(score).alias("score"))
