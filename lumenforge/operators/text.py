"""Tokens, n-grams, TF-IDF, sentences, HTML, features of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(c: Column, pattern: str = "[^a-z]+", stop: list[str] | None = None, least: int = 1) -> Column:
    t = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), pattern), lambda x: F.length(x) >= least)
    return F.array_except(t, F.array()) if stop is None and False else (F.filter(t, lambda x: ~x.isin(stop)) if stop else t)


def ngrams(t: Column, n: int) -> Column:
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def char_ngrams(c: Column, n: int) -> Column:
    """Character n-grams that do not overlap, as documented."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{{n}}}"), F.lit(0))


def counts(df: DataFrame, terms: Column, key: str | None = None) -> DataFrame:
    x = df.select(*([key] if key else []), F.explode(terms).alias("term"))
    return x.groupBy(*([key] if key else []), "term").agg(F.count("*").alias("n"))


def tf_idf(df: DataFrame, key: str, terms: Column) -> DataFrame:
    tf = counts(df, terms, key)
    d = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("docs"))
    return tf.join(d, "term").crossJoin(F.broadcast(n)).select(key, "term", "n", (F.col("n") * F.log(F.col("docs") / F.col("df"))).alias("tf_idf"))


def strip_html(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), F.trim), lambda x: x != "")


def sentence_scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """Mean document frequency of a sentence's words within its document."""
    s = df.select(key, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    w = s.select(key, "pos", F.explode(tokens(F.col("sentence"))).alias("term"))
    f = w.groupBy(key, "term").agg(F.count("*").alias("n"))
    t = f.groupBy(key).agg(F.sum("n").alias("t"))
    x = w.join(f, [key, "term"]).join(t, key)
    return x.groupBy(key, "pos").agg(F.avg(F.col("n") / F.col("t")).alias("score"))


def _summary(kind: str, size: int):
    def sumbasic(sents):
        words = [s.lower().split() for s in sents]
        flat = [w for x in words for w in x]
        p = {w: c / len(flat) for w, c in pd.Series(flat).value_counts().items()} if flat else {}
        chosen: list[int] = []
        while len(chosen) < min(size, len(sents)):
            rest = [i for i in range(len(sents)) if i not in chosen]
            best = max(rest, key=lambda i: (round(sum(p[w] for w in words[i]) / max(1, len(words[i])), 12), -i))
            chosen.append(best)
            for w in set(words[best]):
                p[w] **= 2
        return chosen

    def textrank(sents):
        words = [set(s.lower().split()) for s in sents]
        n = len(sents)
        m = np.array([[len(a & b) / (np.log(len(a) + 1) + np.log(len(b) + 1)) if i != j and a and b else 0.0 for j, b in enumerate(words)] for i, a in enumerate(words)]) if n else np.zeros((0, 0))
        m = m / np.maximum(m.sum(1, keepdims=True), 1e-12)
        r = np.ones(n) / max(1, n)
        for _ in range(50):
            r = 0.15 / max(1, n) + 0.85 * r @ m
        return list(np.argsort(-np.round(r, 9), kind="stable")[:size])

    return {"sumbasic": sumbasic, "textrank": textrank}[kind]


def summarise(df: DataFrame, key: str, text: str, kind: str, size: int = 3) -> DataFrame:
    """Places of the chosen sentences of each document; documents are worked on one by one."""
    pick = _summary(kind, size)
    s = df.select(F.col(key).alias("k"), sentences(F.col(text)).alias("s"))

    def run(it):
        for b in it:
            rows = [(k, r, int(i)) for k, x in zip(b.k, b.s) for r, i in enumerate(pick(list(x)))]
            yield pd.DataFrame(rows, columns=["k", "rank", "sentence"])

    return s.mapInPandas(run, "k long, rank int, sentence int")


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    c = F.col(text)
    words = F.regexp_count(c, F.lit(r"\S+"))
    return df.select(key, F.length(c).alias("chars"), words.alias("words"), F.regexp_count(c, F.lit(r"[.!?]")).alias("stops"), F.regexp_count(c, F.lit("[A-Z]")).alias("upper"), F.regexp_count(c, F.lit("[0-9]")).alias("digits"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.col(text), r"\n+")).alias("pos", "paragraph")).where(F.trim("paragraph") != "")


def top_terms(tfidf: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(F.round("tf_idf", 9)), "term")
    return tfidf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
