"""Toxicity by maximum-scoring segments of token log-odds.

Token weights are log-odds between toxic and clean documents under a Dirichlet prior
(prior weight in proportion to a token's count in both), kept where |z| is large or where so
many toxic documents can't be chance.  Other tokens cost a small drift.  Counts are of documents, so a text that repeats one token
counts once, and equal texts of the sample count as one.  Where a token follows few distinct tokens in its toxic documents (copies
of a text that differ elsewhere) these are fewer witnesses, and count so; a token without a weight of its own takes that of its first five letters.  One linear scan finds all maximal segments of positive score.
Under clean text the best score S of n tokens follows an extreme-value law with
P(best >= S) = 1 - exp(-K n exp(-lambda S)); lambda solves sum p exp(lambda s) = 1 over
the clean tokens, K comes from clean documents kept apart.  A passage is significant if its
P is under 0.01.  A document's score is a logistic function, fitted on those documents, of
its strongest passage and of the evidence of its significant passages together.

Learning uses at most ``sample`` labelled rows of each class (chosen by a hash of doc_id),
a quarter of them apart for calibration; scoring covers whole texts of all rows.  The weights that come to the driver
are those of tokens with evidence from several rows of that sample, and so bounded by it.

Defined cases: null or empty text scores as one without passages; no labelled rows of a class:
every score is the share of toxic labels (0.5 without labels); a document with several label
rows counts as toxic if one of them says so.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, parts, stored

TOKEN = re.compile(r"[^\W_]+")
OUT = "doc_id long, score double, n_tokens long, passages array<struct<start:long,end:long,score:double,p:double>>"


def maximal_segments(at: list[int], s: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence whose tokens score s[k] at
    position at[k] and -drift elsewhere; linear time.
    """
    left: list[float] = []
    right: list[float] = []
    span: list[tuple[int, int]] = []
    back: list[int] = []  # nearest earlier segment with a smaller left sum
    total, last = 0.0, -1
    for p, x in zip(at, s, strict=True):
        total -= drift * (p - last - 1)
        last = p
        if x <= 0:
            total += x
            continue
        lo, hi, start = total, total + x, p
        total = hi
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                left.append(lo)
                right.append(hi)
                span.append((start, p + 1))
                back.append(j)
                break
            lo, start = left[j], span[j][0]
            del left[j:], right[j:], span[j:], back[j:]
    return [(a, b, hi - lo) for (a, b), lo, hi in zip(span, left, right, strict=True)]


def features_of(tokens: set[str]) -> set[str]:
    return tokens | {t[:5] + "*" for t in tokens if len(t) > 5}


class Segments:
    def __init__(self, weights: dict[str, float], drift: float, clean: np.ndarray, scores: np.ndarray):
        """clean: counts in clean documents of tokens that score scores."""
        self.weights, self.drift, self.k, self.prior = weights, drift, 0.1, 0.5
        self.known: dict[str, float] = {}
        p = clean / max(1.0, clean.sum())
        lo, hi = 1e-6, 20.0
        f = lambda x: float((p * np.exp(np.minimum(x * scores, 500))).sum()) - 1
        if f(hi) <= 0:
            self.lam = hi
        else:
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
            self.lam = max(lo, 0.05)
        self.coef = None

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float, float]]]:
        tokens, at, s = TOKEN.findall((text or "").lower()), [], []
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for t in set(tokens).difference(known):
            x = self.weights.get(t)
            known[t] = self.weights.get(t[:5] + "*", 0.0) if x is None and len(t) > 5 else x or 0.0
        for i, x in enumerate(map(known.__getitem__, tokens)):
            if x:
                at.append(i)
                s.append(x)
        n, out = len(tokens), []
        for a, b, x in maximal_segments(at, s, self.drift):
            e = self.k * max(n, 1) * math.exp(-min(700.0, self.lam * x))
            out.append((a, b, x, -math.expm1(-e)))
        return n, out

    def features(self, n: int, found: list) -> tuple[float, float, float]:
        logs = [min(60.0, self.lam * x - math.log(max(1e-9, self.k * max(n, 1)))) for _, _, x, _ in found]
        best = max(logs, default=-8.0)
        return max(-8.0, best), math.log1p(sum(x for x, f in zip(logs, found, strict=True) if f[3] < 0.01)), 1.0

    def score(self, n: int, found: list) -> float:
        if self.coef is None:
            return self.prior
        z = float(np.dot(self.coef, self.features(n, found)))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))


def labelled(docs: DataFrame, labels: DataFrame, use: Column, sample: int) -> tuple[DataFrame, int, int]:
    """text, toxic and calibration flag of the bounded sample of labelled rows."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(use)
    lab = lab.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {int(r["toxic"] > 0): r["count"] for r in lab.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    keep = F.lit(False)
    for k, c in n.items():
        keep = keep | (((F.col("toxic") > 0).cast("int") == k) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / c)) + 1))
    picked = F.broadcast(lab.where(keep))  # about 2 * sample rows of 12 bytes
    rows = parts(docs).join(picked, "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), (F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(4)) == 0).alias("apart"))
    rows = stored(rows.groupBy("text", "apart").agg(F.max("toxic").alias("toxic")), "sample")
    return rows, n.get(1, 0), n.get(0, 0)


def train(docs: DataFrame, labels: DataFrame, use: Column, sample: int = 6000, z_least: float = 3.5, prior: float = 0.05, drift: float = 0.05, chance: float = 8.0) -> Segments:
    rows, toxic, clean = labelled(docs, labels, use, sample)

    def tally(batches):
        from collections import Counter

        c, often, before = (Counter(), Counter()), Counter(), {}
        for b in batches:
            for t, y, apart in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), b.column("apart").to_pylist(), strict=True):
                if not apart:
                    tokens = TOKEN.findall((t or "").lower())
                    c[y].update(features_of(set(tokens)))
                    if y:
                        first: dict[str, str] = {}
                        for w, x in zip(tokens, ["", *tokens], strict=False):
                            for f in features_of({w}) - first.keys():
                                first[f] = x
                        for f, x in first.items():
                            before[f] = before.get(f, 0) | 1 << zlib.crc32(x.encode()) % 63
                    else:
                        often.update(tokens)
                        often.update(x[:5] + "*" for x in tokens if len(x) > 5)
        keys = list(c[0] | c[1])
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([c[1][k] for k in keys], pa.int64()), pa.array([c[0][k] for k in keys], pa.int64()), pa.array([often[k] for k in keys], pa.int64()), pa.array([before.get(k, 0) for k in keys], pa.int64())], names=["token", "t", "c", "o", "b"])

    counts = rows.mapInArrow(tally, "token string, t long, c long, o long, b long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.sum("o").alias("o"), F.bit_count(F.bit_or("b")).alias("contexts"))
    counts = stored(counts, "counts")
    nt, nc, no, size = (x or 0 for x in counts.agg(F.sum("t"), F.sum("c"), F.sum(F.when(~F.col("token").endswith("*"), F.col("o"))), F.count("*")).first())
    model = Segments({}, drift, np.array([1.0]), np.array([-drift]))
    model.prior = toxic / (toxic + clean) if toxic + clean else 0.5
    if not nt or not nc:
        return model
    # in copies of a text that differ elsewhere a token always follows the same one; such documents are fewer witnesses
    varied = F.least(F.lit(1.0), F.col("contexts") / (0.4 * F.least("t", F.lit(20))))
    counts = counts.withColumn("t", F.when(F.col("t") > 0, F.col("t") * varied).otherwise(0.0))
    a = F.lit(prior) * (F.col("t") + F.col("c"))
    prior *= nt + nc
    odds = F.log((F.col("t") + a) / (nt + prior - F.col("t") - a)) - F.log((F.col("c") + a) / (nc + prior - F.col("c") - a))
    z = odds / F.sqrt(1 / (F.col("t") + a) + 1 / (F.col("c") + a))
    # a rare token's z is small even if all its documents are toxic: the bound on its binomial tail says whether that is chance
    seen, base = F.col("t") + F.col("c"), nt / (nt + nc)
    gap = lambda k, p: F.when(k > 0, k * F.log(k / (seen * p))).otherwise(0.0)
    telling = (F.col("t") > seen * base) & (gap(F.col("t"), base) + gap(F.col("c"), 1 - base) > math.log(max(2, size)) + chance)
    kept = counts.select("token", "o", odds.alias("odds"), z.alias("z"), telling.alias("telling")).where((F.abs("z") >= z_least) | F.col("telling")).collect()
    weights = {r["token"]: max(-2.0, min(6.0, r["odds"])) for r in kept}
    scores = np.array([*(weights[r["token"]] for r in kept), -drift])
    known = [float(r["o"]) for r in kept]
    model = Segments(weights, drift, np.array([*known, max(1.0, no - sum(known))]), scores)
    model.prior = toxic / (toxic + clean)
    _calibrate(model, rows.where("apart").select("text", "toxic"), toxic, clean)
    return model


def _calibrate(model: Segments, rows: DataFrame, toxic: int, clean: int) -> None:
    """Two passes over the rows kept apart; each sends three numbers a row."""

    def numbers(f):
        def scan(batches):
            for b in batches:
                got = [f(*model.passages(t)) for t in b.column("text").to_pylist()]
                yield pa.record_batch([b.column("toxic").cast(pa.int32()), *(pa.array([x[i] for x in got], pa.float64()) for i in range(3))], names=["toxic", "x", "y", "z"])

        return rows.mapInArrow(scan, "toxic int, x double, y double, z double").collect()

    got = numbers(lambda n, found: (float(n), max((f[2] for f in found), default=0.0), float(len(found))))
    best = [(r["x"], r["y"]) for r in got if not r["toxic"] and r["z"] and r["x"]]
    if best:  # the mean of lambda * S - ln n is Euler's constant + ln K
        model.k = float(np.exp(np.clip(np.mean([model.lam * s - math.log(n) for n, s in best]) - 0.5772, -12, 2)))
    got = numbers(model.features)
    y = np.array([r["toxic"] for r in got], float)
    if len(set(y.tolist())) < 2:
        return
    x = [(r["x"], r["y"], r["z"]) for r in got]
    x = np.array(x)
    w = np.where(y == 1, toxic / max(1.0, y.sum()), clean / max(1.0, (1 - y).sum()))  # back to the shares of all rows
    w *= len(y) / w.sum()
    c = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps, slightly ridged
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        g = x.T @ (w * (y - p)) - 1e-2 * c
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(c))
        step = np.linalg.solve(h, g)
        c += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.coef = c


def score(docs: DataFrame, model: Segments, significant: float = 0.01) -> DataFrame:
    """doc_id, score, n_tokens and the significant passages (token positions) of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p", pa.float64())]))
        for b in batches:
            s, n, out = [], [], []
            for t in b.column("text").to_pylist():
                k, found = model.passages(t)
                s.append(model.score(k, found))
                n.append(k)
                out.append([dict(zip(("start", "end", "score", "p"), f, strict=True)) for f in found if f[3] < significant])
            yield pa.record_batch([b.column("doc_id"), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(out, kind)], names=["doc_id", "score", "n_tokens", "passages"])

    return parts(docs).mapInArrow(run, OUT)


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, threshold: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages; learns from labels of rows not held out."""
    model = train(docs, labels, crc_mod(F.col("doc_id"), fold) != held, **options)
    return score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
