"""License scans by a positional rare-token index.  DataFrame operations only.

Templates are sentences of licences; words between square brackets are a template's mandatory key phrase.  The IDF of
each licence word is counted over all texts.  The index holds one posting (word, template, position) for the word of each
key phrase with the highest IDF.  A file's words that have a posting there, the rarest of its licence words, are looked up; text
position less template position gives the place where the template would start.  At each such place the
postings of the template's other words are intersected by relative position: all words of the key
phrase must stand where the template has them, and words with half of the template's IDF in all.

A text that lacks a word of every key phrase is not looked up, which loses nothing.

Defined cases: null and empty texts have no words, no labels and score 0; equal
templates at several places give one label; repeated and null ids are rows of their own; an
empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, parts, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: fixed values: sentences of public licences and of their usual notices, as words
TEMPLATES = (
    ("mit", "released under the [mit license]"),
    ("mit", "licensed under the [mit license]"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute [sublicense and or sell copies of the software]"),
    ("mit", "[the above copyright notice and this permission notice shall be included in all] copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses license 2 0]"),
    ("apache-2.0", "[distributed under the license is distributed on an as is basis] without warranties or conditions of any kind either express or implied"),
    ("gpl-2.0", "licensed under the gnu [general public license version 2]"),
    ("gpl-2.0", "under the terms of the gnu [general public license as published by the free software foundation either version 2]"),
    ("gpl-3.0", "licensed under the gnu [general public license version 3]"),
    ("gpl-3.0", "under the terms of the gnu [general public license as published by the free software foundation either version 3]"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty see the gnu [general public license for more details]"),
    ("lgpl", "licensed under the gnu [lesser general public license]"),
    ("agpl", "licensed under the gnu [affero general public license]"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license] version 2 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code [must retain the above copyright notice this list of conditions] and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors [may be used to endorse or promote products derived from this software] without specific prior written permission"),
    ("isc", "[permission to use copy modify and or distribute] this software for any purpose with or without fee is hereby granted"),
    ("zlib", "[altered source versions must be plainly marked as such] and must not be misrepresented as being the original software"),
    ("bsl-1.0", "[boost software license] version 1 0"),
    ("epl-2.0", "made available under the terms of the [eclipse public license] 2 0"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa-4.0", "licensed under [cc by sa 4 0]"),
    ("cc-by-nc-4.0", "licensed under [cc by nc 4 0]"),
    ("cc-by-nd-4.0", "licensed under [cc by nd 4 0]"),
    ("cc-by-nc-sa-4.0", "licensed under [cc by nc sa 4 0]"),
    ("cc-by", "licensed under a [creative commons attribution] license"),
    ("cc0", "released under [cc0 1 0] universal"),
    ("unlicense", "this is free and unencumbered software [released into the public domain]"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software [either in source code form or as a compiled binary] for any purpose"),
    ("public-domain", "this work is in the [public domain]"),
)


class Template:
    """label, whether it is a base phrase, words, and the positions [lo, hi) of the key phrase."""

    def __init__(self, label: str, text: str, base: bool):
        raw = text.split()
        self.label, self.base = label, base
        self.words = [w.strip("[]") for w in raw]
        self.lo = next(i for i, w in enumerate(raw) if w.startswith("["))
        self.hi = next(i for i, w in enumerate(raw) if w.endswith("]")) + 1

    @property
    def key(self) -> list[str]:
        return self.words[self.lo : self.hi]


def read_templates(templates: Iterable[tuple[str, str]] = TEMPLATES, base: dict[str, str] = BASE) -> list[Template]:
    return [Template(v, f"[{k}]", True) for k, v in base.items()] + [Template(label, text, False) for label, text in templates]


def lower_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.  lower() is quicker, and differs only for the Kelvin sign in what counts here."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.when(t.contains("K"), ascii_lower(t)).otherwise(F.lower(t)), F.lit(WORD), F.lit(0))


def idf_of(n: int, df: int) -> float:
    return math.log((n + 1.0) / (df + 1.0)) + 0.01


def license_scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark, known = docs.sparkSession, read_templates(templates, base)
    vocabulary = sorted({w for t in known for w in t.words})
    whole = reduce(or_, (reduce(and_, (F.array_contains("has", w) for w in sorted(k))) for k in {frozenset(t.key) for t in known}))
    w = parts(docs).select("doc_id", lower_words(F.col("text")).alias("words"))
    w = w.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, vocabulary))).alias("has"), "words")
    w = w.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", "has", F.when(whole, F.col("words")).alias("words"))
    texts = stored(w, "words")

    n = texts.count()
    df = {r["word"]: r["df"] for r in texts.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()}  # a row for each licence word
    idf = {w: idf_of(n, df.get(w, 0)) for w in vocabulary}
    rows = []
    for i, t in enumerate(known):
        at = max(range(t.lo, t.hi), key=lambda j, t=t: (idf[t.words[j]], -j))
        rows.append((i, t.label, t.base, t.words[at], at, t.words, [idf[w] for w in t.words], t.lo, t.hi - t.lo))
    index = spark.createDataFrame(rows, "template int, label string, base boolean, word string, position int, phrase array<string>, idf array<double>, lo int, size int")
    reach = max(len(t.words) for t in known)

    rare = sorted({r[3] for r in rows})
    found = F.filter(F.transform("words", lambda x, i: F.when(x.isin(rare), F.struct(i.alias("at"), x.alias("word")))), lambda p: p.isNotNull())
    around = F.transform(found, lambda p: F.struct(p["at"].alias("at"), p["word"].alias("word"), F.greatest(p["at"] - reach, F.lit(0)).alias("from"), F.slice("words", F.greatest(p["at"] - reach, F.lit(0)) + 1, F.lit(2 * reach)).alias("near")))
    places = texts.where("words is not null").select("row", F.explode(around).alias("p")).select("row", "p.*")
    met = places.join(F.broadcast(index), "word").withColumn("start", F.col("at") - F.col("position"))  # a row for each template
    agrees = F.transform("phrase", lambda w, j: F.coalesce(F.get("near", F.col("start") + j - F.col("from")) == w, F.lit(False)))
    met = met.withColumn("agrees", agrees).where(F.forall(F.slice("agrees", F.col("lo") + 1, F.col("size")), lambda x: x))
    share = F.aggregate(F.zip_with("agrees", "idf", lambda a, x: F.when(a, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / F.aggregate("idf", F.lit(0.0), lambda a, x: a + x)
    own = F.col("base")
    met = met.select("row", "label", "base", "start", share.alias("share")).where(own | (F.col("share") >= least))
    hits = met.groupBy("row").agg(
        F.count(F.when(own, 1)).alias("n_base"),
        F.min(F.when(own, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(own, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(own, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.least(F.max("share"), F.lit(1.0)).alias("score"),
    )
    empty = F.lit("")
    return texts.select("row", "doc_id", "n_words").join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_scan(text: str | None) -> tuple:
    """What license_scan says of base phrases, for tests."""
    words = words_of(text)
    starts, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_labels(texts: list[str | None], least: float = 0.5) -> list[tuple[str, float]]:
    """Labels and score of each text, by trying every template at every place; for tests."""
    known, docs = read_templates(), [words_of(t) for t in texts]
    vocabulary = {w for t in known for w in t.words}
    idf = {w: idf_of(len(docs), sum(w in d for d in map(set, docs))) for w in vocabulary}
    out = []
    for words in docs:
        labels, score = set(), 0.0
        for t in known:
            total = sum(idf[w] for w in t.words)
            for start in range(-len(t.words), len(words)):
                at = [0 <= start + j < len(words) and words[start + j] == w for j, w in enumerate(t.words)]
                share = sum(idf[w] for w, a in zip(t.words, at, strict=True) if a) / total
                if all(at[t.lo : t.hi]) and (t.base or share >= least):
                    labels.add(t.label)
                    score = max(score, min(1.0, share))
        out.append((",".join(sorted(labels)), score))
    return out
