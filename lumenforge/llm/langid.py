"""Language ID by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over byte trigrams
(a linear model: smoothed log-odds of the languages whose bit is 1 against the others) gives
a margin; the language whose codeword has the least weighted loss wins.  A bit's weight is
how far its accuracy on the training rows exceeds chance.  A decision whose loss is close to the second's is flagged.

Training counts trigrams on at most ``sample`` documents of each language (chosen by a hash of
doc_id, so the same at any partitioning); whole texts are counted there and in prediction.

Defined cases: null text, or one without a letter: `und`, score 0, ambiguous; no training
rows: all `und`; a null lang trains nothing; repeated ids are rows of their own.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc_mod, parts

BITS = 15
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
ASCII_LETTER = re.compile("[A-Za-z]")
OUT = "doc_id long, lang_pred string, score double, ambiguous boolean"


def trigrams(text: str) -> np.ndarray:
    """Hashes, of BITS bits, of the byte trigrams of the lower-cased text, other than spaces alone."""
    b = np.frombuffer(b" " + text.lower().encode().translate(SPACED) + b" ", np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    x = x[x != 0x202020]
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is of a letter category; digits in a ring or raised, and fractions, are not."""
    return bool(text) and (ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of 0/1: all distinct splits for few classes, else random ones far apart."""
    if k <= 1:
        return np.zeros((k, 1), np.int8)
    if k <= 5:
        cols = [c for c in itertools.product((0, 1), repeat=k) if c[0] == 1 and sum(c) < k]
        return np.array(cols, np.int8).T
    rng, n, best = np.random.default_rng(seed), 15 * max(1, int(np.ceil(np.log2(k)))), None
    for _ in range(200):
        m = rng.integers(0, 2, (k, n), dtype=np.int8)
        m = m[:, (m.min(0) != m.max(0))]
        g = (2.0 * m - 1) @ (2.0 * m.T - 1)  # agreeing bits less differing ones
        np.fill_diagonal(g, -m.shape[1])
        d = (m.shape[1] - g.max()) / 2
        if best is None or d > best[0]:
            best = (d, m)
    return best[1]


class Codes:
    """langs, codes (k x n), weights (2**BITS x n), bit weights, loss scale."""

    def __init__(self, counts: dict[str, np.ndarray], smooth: float = 0.5):
        self.langs = sorted(counts)
        self.codes = codewords(len(self.langs))
        c = np.array([counts[x] for x in self.langs], float).reshape(len(self.langs), 1 << BITS)
        share = (c + smooth) / (c + smooth).sum(1, keepdims=True)
        cols = []
        for bit in self.codes.T:
            one, zero = share[bit == 1], share[bit == 0]
            cols.append(np.log(one.mean(0)) - np.log(zero.mean(0)) if len(one) and len(zero) else np.zeros(1 << BITS))
        self.weights = np.ascontiguousarray(np.array(cols).T, np.float32)
        self.bit_weight = np.ones(self.codes.shape[1])

    def margins(self, text: str) -> tuple[np.ndarray, int]:
        x = trigrams(text)
        if len(x) > 1 << 16:
            s = np.bincount(x, minlength=1 << BITS).astype(np.float64) @ self.weights
        else:
            s = self.weights.take(x, axis=0).sum(0, dtype=np.float64)
        return s / max(1, len(x)), len(x)

    def decode(self, text: str | None, close: float = 0.02) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        m, n = self.margins(text)
        signs = 2.0 * self.codes - 1
        loss = np.logaddexp(0, -4 * signs * m) @ self.bit_weight / self.bit_weight.sum()
        p = np.exp(-(loss - loss.min()) * min(n, 200) / 4)
        p /= p.sum()
        best = int(np.argmin(loss))
        rest = np.delete(loss, best)
        return self.langs[best], float(p[best]), bool(len(rest) and rest.min() - loss[best] < close)


def train(docs: DataFrame, use: Column, sample: int = 1500) -> Codes:
    """A model of documents(doc_id, text, lang) where use holds and lang is not null."""
    rows = docs.where(use & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("doc_id"), F.col("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return Codes({})
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / n)) + 1))

    def count(batches):
        got: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if has_letter(t):
                    c = got.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    c += np.bincount(trigrams(t), minlength=1 << BITS)
        yield pa.record_batch([pa.array(list(got), pa.string()), pa.array([c.tobytes() for c in got.values()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    picked = rows.where(keep).repartition(6)
    for r in picked.mapInArrow(count, "lang string, counts binary").collect():  # 6 rows a language at most
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    model = Codes(total)

    def judge(batches):
        right, n = np.zeros(len(model.bit_weight)), 0
        for b in batches:
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                if has_letter(t):
                    m, _ = model.margins(t)
                    right += (m > 0) == (model.codes[model.langs.index(lang)] == 1)
                    n += 1
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([right.tobytes()], pa.binary())], names=["n", "right"])

    got = picked.mapInArrow(judge, "n long, right binary").collect()  # a row for each of 6 tasks
    n = sum(r["n"] for r in got)
    if n and len(total) > 1:  # a bit no better than chance counts nearly nothing
        model.bit_weight = np.maximum(0.02, 2 * sum(np.frombuffer(r["right"], float) for r in got) / n - 1)
    return model


def predict(docs: DataFrame, model: Codes) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs."""

    def run(batches):
        for b in batches:
            got = [model.decode(t) for t in b.column("text").to_pylist()]
            lang, score, flag = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return parts(docs).mapInArrow(run, OUT)


def identify(docs: DataFrame, fold: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learns from the rows that are not held out."""
    rest = crc_mod(F.col("doc_id"), fold)
    out = predict(docs, train(docs, rest != held, **options))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), fold) == held).alias("held_out"), "lang_pred", "score", "ambiguous")
