"""The stages against a brute-force version on a small fixture."""

import random

import corpus_pipeline as cp
from lumenforge.llm import mixing

from .test_dedup import classes
from .test_models import WORDS


def jaccard(a, b, n=5):
    s = lambda t: {tuple(w[i : i + n]) for w in [t.lower().split()] for i in range(max(1, len(w) - n + 1))}
    x, y = s(a), s(b)
    return len(x & y) / len(x | y)


def world():
    r = random.Random(4)
    vocab = WORDS["en"] + ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    docs = [(i, say(r.randrange(60, 200)), "en", r.choice("abc"), 0) for i in range(80)]
    docs += [(100, docs[3][1].upper(), "en", "a", 0), (101, docs[3][1], "en", "b", 0)]  # exact copies
    near = docs[7][1].split()
    near[20] = "changed"
    docs += [(102, " ".join(near), "en", "c", 0)]  # a near copy
    docs += [(103, say(40) + " " + items[2][1] + " " + say(40), "en", "a", 0)]  # a benchmark item
    docs += [(104, None, "en", "a", 0), (105, "", "en", "a", 0), (106, "12 --", "en", "a", 0)]  # no language
    return items, docs


def test_stages_match_brute_force(spark, tmp_path):
    items, docs = world()
    d = f"{tmp_path}/t"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = {i: t for i, t, *_ in docs if t and any(c.isalpha() for c in t)}
    low = {}
    for i, t in kept.items():
        low[t.lower()] = max(i, low.get(t.lower(), -1))
    kept = {i: t for i, t in kept.items() if low[t.lower()] == i}
    of = classes(list(kept), lambda a, b: jaccard(kept[a], kept[b]) >= 0.8)
    kept = {i: t for i, t in kept.items() if of[i] == i}
    kept = {i: t for i, t in kept.items() if not any(x in t for _, x in items)}
    x = spark.read.parquet(f"{d}/documents.parquet")
    columns = x.columns
    sizes = []
    for name, stage in cp.STAGES:
        x = stage(spark, x, d)
        sizes.append(x.count())
        if name != cp.STAGES[-1][0]:
            assert x.columns == columns
    assert sizes[0] == len(docs) - 3 and sizes == sorted(sizes, reverse=True)
    assert {r.doc_id for r in x.collect()} == set(kept)
    got = {tuple(r) for r in cp.run(spark, d).collect()}
    assert got == {tuple(r) for r in x.collect()}
    want = spark.createDataFrame([(i, t, "en", s, 0) for i, t, _, s, _ in docs if i in kept], "doc_id long, text string, lang string, source string, n_chars long")
    assert got == {tuple(r) for r in mixing.mixed(want).collect()}


def test_stages_of_an_empty_table(spark, tmp_path):
    items, _ = world()
    d = f"{tmp_path}/t"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert cp.run(spark, d).count() == 0


def test_order_and_names():
    assert [n for n, _ in cp.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing"]


def test_language_stage_rejects_what_it_says(spark):
    """Without a language to learn from, texts with letters stay; of lettered texts only a language named und goes."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    r = random.Random(6)
    say = lambda k: " ".join(r.choice(WORDS[k]) for _ in range(30))
    bare = [(900, None, None, "a", 0), (901, "", None, "a", 0), (902, "12 --", None, "a", 0)]
    none = [(i, say("en"), None, "a", 0) for i in range(5)] + bare
    assert {x.doc_id for x in cp.language(spark, spark.createDataFrame(none, ddl), "").collect()} == set(range(5))
    rows = [(i, say("de" if i % 2 else "en"), "und" if i % 2 else "en", "a", 0) for i in range(60)] + [(100, say("fr"), None, "a", 0), *bare]
    got = {x.doc_id for x in cp.language(spark, spark.createDataFrame(rows, ddl), "").collect()}
    assert got - {100} == set(range(0, 60, 2))
    rows = [(i, t, "de" if lang == "und" else lang, s, n) for i, t, lang, s, n in rows]
    assert {x.doc_id for x in cp.language(spark, spark.createDataFrame(rows, ddl), "").collect()} == {*range(60), 100}
