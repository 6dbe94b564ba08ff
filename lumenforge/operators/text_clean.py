"""Cleaning of text and of token arrays: column expressions, and a stemmer for batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import dense_index

# common English words and contractions: fixed values
STOP = "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
CONTRACTIONS = {"can't": "cannot", "won't": "will not", "shan't": "shall not", "let's": "let us", "n't": " not", "'re": " are", "'ve": " have", "'ll": " will", "'d": " would", "'m": " am"}
DIGITS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def without_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\[[^\]]*\]", "")


def expanded(c: Column) -> Column:
    """Contractions written out (lower case)."""
    out = F.lower(c)
    for short, long in CONTRACTIONS.items():
        out = F.replace(out, F.lit(short), F.lit(long))
    return out


def digits_as_words(c: Column) -> Column:
    """Each digit as its word."""
    out = c
    for i, w in enumerate(DIGITS):
        out = F.replace(out, F.lit(str(i)), F.lit(f" {w} "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def kept(tokens: Column, stop: list[str] | None = None, least: int = 1, pattern: str | None = None, numbers: bool = True, only: list[str] | None = None) -> Column:
    """Tokens that pass all filters: not a stop word, long enough, matching, not a number, on a list."""

    def ok(x: Column) -> Column:
        good = F.length(x) >= least
        if stop:
            good = good & ~x.isin(stop)
        if pattern:
            good = good & x.rlike(pattern)
        if not numbers:
            good = good & ~x.rlike(r"^[0-9.,]+$")
        if only:
            good = good & x.isin(only)
        return good

    return F.filter(tokens, ok)


def frequent_tokens(df: DataFrame, key: str, tokens: Column, more_than: int) -> DataFrame:
    """key, tokens (in order) whose count over all rows exceeds a number; a token's count comes by a join, not a list."""
    t = df.select(key, F.posexplode(tokens).alias("pos", "term"))
    c = t.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("term")
    return t.join(c, "term", "left_semi").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))


def passages(sentences: Column, size: int) -> Column:
    """Sliding passages of ``size`` sentences."""
    at = F.when(F.size(sentences) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(sentences) - size + 1)))
    return F.transform(at, lambda i: F.array_join(F.slice(sentences, i, size), " "))


def has_words(tokens: Column, words: list[str]) -> list[Column]:
    return [F.array_contains(tokens, w).alias(f"has_{w}") for w in words]


def ngram_vector(df: DataFrame, key: str, grams: Column, least: int) -> DataFrame:
    """key, gram index, count, over grams that occur at least so often; indices are by gram."""
    g = df.select(key, F.explode(grams).alias("gram"))
    v = g.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    v = dense_index(v.select("gram"), "gram")
    return g.groupBy(key, "gram").agg(F.count("*").alias("count")).join(v, "gram").select(key, "idx", "count")


def clean(c: Column) -> Column:
    """ASCII, brackets gone, lower-case words of three letters or more that are no stop words."""
    t = F.split(F.lower(without_brackets(ascii_only(F.coalesce(c, F.lit(""))))), "[^a-z]+")
    return kept(t, STOP, 3)


_VOWEL = re.compile(r"[aeiouy]")


class Stemmer:
    """Porter's suffix rules, over a measure of vowel-consonant runs."""

    # suffixes and what takes their place: fixed values
    STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
    STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
    STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

    @staticmethod
    def shape(w: str) -> str:
        """v and c for each letter; y is a vowel after a consonant."""
        out = ""
        for i, ch in enumerate(w):
            out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
        return out

    def measure(self, w: str) -> int:
        return len(re.findall("v+c+", self.shape(w)))

    def short_end(self, w: str) -> bool:
        return self.shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def __call__(self, w: str) -> str:
        if len(w) < 3:
            return w
        for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + new
                break
        cut = next((e for e in ("eed", "ed", "ing") if w.endswith(e)), None)
        if cut == "eed":
            w = w[:-1] if self.measure(w[:-3]) else w
        elif cut and "v" in self.shape(w[: -len(cut)]):
            w = w[: -len(cut)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and self.shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif self.measure(w) == 1 and self.short_end(w):
                w += "e"
        if w.endswith("y") and "v" in self.shape(w[:-1]):
            w = w[:-1] + "i"
        for rules in (self.STEP2, self.STEP3):
            hit = max((r for r in rules if w.endswith(r[0])), key=lambda r: len(r[0]), default=None)
            if hit and self.measure(w[: -len(hit[0])]) > 0:
                w = w[: -len(hit[0])] + hit[1]
        end = max((e for e in self.STEP4 if w.endswith(e)), key=len, default=None)
        if end:
            stem = w[: -len(end)]
            if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or m == 1 and not self.short_end(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w[:-1]) > 1:
            w = w[:-1]
        return w


def stemmed(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, tokens stemmed; each word of a batch is worked on once."""
    kind = dict(df.dtypes)[key]

    def run(it):
        stem, known = Stemmer(), {}
        for b in it:
            out = []
            for ws in b["t"]:
                for w in ws:
                    if w not in known:
                        known[w] = stem(w)
                out.append([known[w] for w in ws])
            if len(known) > 1_000_000:
                known.clear()
            yield pd.DataFrame({key: b[key], "stems": out})

    return df.select(key, tokens.alias("t")).mapInPandas(run, f"{key} {kind}, stems array<string>")
