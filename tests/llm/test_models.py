"""Language ID and toxicity: held-out accuracy, and the defined cases."""

import random
import zlib

from lumenforge.llm import langid, toxicity
from pyspark.sql import functions as F

WORDS = {
    "en": "the and that with from have this which would there their about when other into more some them than only could time these".split(),
    "de": "der die und den von das mit sich auf für ist nicht dem eine auch werden aus hat dass sie nach bei einer einem noch wie über".split(),
    "fr": "le la les des une est dans que pour qui pas sur plus par avec mais comme nous sont cette être fait tout leur même où deux".split(),
}


def corpus(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(5, 60))), lang, "x", i))
    return rows


DDL = "doc_id long, text string, lang string, lang_pred string, score int"


def test_languages_of_held_out_rows(spark):
    rows = corpus(400)
    edge = [(1000, None, "en", "", 0), (1001, "", "de", "", 0), (1002, "12 34 !!", "fr", "", 0), (1004, "²", "en", "", 0), (1005, "12 ½ 3 ①", None, "", 0), (1003, "und der die das nicht " * 20_000, None, "", 0), (None, "the and that with", "en", "", 0), (3, rows[3][1], rows[3][2], "", 0)]
    got = langid.identify(spark.createDataFrame(rows + edge, DDL)).collect()
    assert len(got) == len(rows) + len(edge)
    truth = {r[0]: r[2] for r in rows}
    out = [(x.lang_pred == truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    assert len(out) > 50 and sum(out) / len(out) > 0.97
    by = {x.doc_id: x for x in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].ambiguous for k in (1000, 1001, 1002, 1004, 1005))
    assert by[1003].lang_pred == "de" and all(0 <= x.score <= 1 for x in got)


def test_label_source_and_id_are_not_inputs(spark):
    rows = corpus(200)
    d = spark.createDataFrame(rows, DDL)
    model = langid.train(d, F.lit(True))
    a = {r.doc_id: r.lang_pred for r in langid.predict(d, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.predict(d.withColumn("lang", F.lit("zz")), model).collect()}
    assert a == b


def test_no_training_rows_or_no_rows(spark):
    d = spark.createDataFrame([(1, "the and", None, "", 0)], DDL)
    assert [x.lang_pred for x in langid.identify(d).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], DDL)).count() == 0


def test_letters_are_letters():
    assert all(langid.has_letter(x) for x in ("a", "12é", "日", "ª", "1 ж"))
    assert not any(langid.has_letter(x) for x in (None, "", "12", "²", "½", "①", "_-", "😀", "٣"))


def test_codewords_part_all_classes():
    for k in (2, 3, 5, 12, 220):
        c = langid.codewords(k)
        assert len(c) == k and len({tuple(x) for x in c.tolist()}) == k
    assert min((c[a] != c[b]).sum() for a in range(0, 220, 3) for b in range(a)) > c.shape[1] // 4


def test_ties_between_languages_are_flagged(spark):
    """Texts that two languages share decide nothing: one is chosen, alike on every run, and flagged."""
    same = "la casa de la luna"
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:60]
    rows = [(i, same, "it" if k % 2 else "es", "", 0) for k, i in enumerate(ids)] + [(1000, same, None, "", 0)]
    got = [langid.identify(spark.createDataFrame(rows, DDL)).where("doc_id = 1000").first() for _ in range(2)]
    assert got[0].ambiguous and got[0] == got[1] and got[0].lang_pred in ("es", "it")


def test_weak_bits_count_less(spark):
    """A bit that training rows contradict half the time loses its weight."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS["en"]) for _ in range(20)), r.choice(["aa", "bb"]), "", 0) for i in range(200)] + [(300 + i, " ".join(r.choice(WORDS["de"]) for _ in range(20)), "de", "", 0) for i in range(100)]
    m = langid.train(spark.createDataFrame(rows, DDL), F.lit(True))
    split = [j for j, bit in enumerate(m.codes.T) if bit[m.langs.index("aa")] != bit[m.langs.index("bb")]]
    whole = [j for j in range(m.codes.shape[1]) if j not in split]
    assert whole and split and m.bit_weight[whole].min() > m.bit_weight[split].max()


BAD = "vile scum trash idiot moron filth".split()


def toxic_corpus(n, seed=2):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS["en"] + WORDS["fr"]) for _ in range(r.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            at = r.randrange(len(w))
            w[at:at] = [r.choice(BAD) for _ in range(r.randrange(3, 9))]
        docs.append((i, " ".join(w), "en", "", 0))
        labels.append((i, 1, int(bad)))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxic_passages_of_held_out_rows(spark):
    docs, labels = toxic_corpus(400)
    edge = [(1000, None, "", "", 0), (1001, "", "", "", 0), (1002, "the and " * 30_000 + " ".join(BAD), "", "", 0), (1003, "the and " * 30_000, "", "", 0), (None, "the", "", "", 0), (3, docs[3][1], "", "", 0)]
    d = spark.createDataFrame(docs + edge, DDL)
    lab = spark.createDataFrame(labels + [(0, 0, 1), (None, 1, 1), (2, 1, None)], LABELS)
    got = toxicity.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(edge) and all(0 <= x.score <= 1 for x in got)
    truth = {i: t for i, _, t in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    right = sum(x.predicted == truth[x.doc_id] for x in held)
    assert len(held) > 50 and right / len(held) > 0.95
    by = {x.doc_id: x for x in got}
    assert by[1000].predicted == by[1001].predicted == by[1003].predicted == 0
    assert by[1000].score == by[1001].score


def test_passages_are_found_where_they_stand(spark):
    docs, labels = toxic_corpus(400)
    model = toxicity.train(spark.createDataFrame(docs, DDL), spark.createDataFrame(labels, LABELS), F.lit(True))
    text = " ".join(["the and"] * 50 + BAD + ["le la"] * 2000 + BAD)
    got = toxicity.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    spans = [(p.start, p.end) for p in got.passages]
    assert (100, 106) in spans and (4106, 4112) in spans


def test_words_of_copies_and_templates_count(spark):
    """A slur that always follows one word, and the words of a text present as many copies, still tell; copies count once."""
    r = random.Random(5)
    say = lambda n: [r.choice(WORDS["en"]) for _ in range(n)]
    docs = [(i, " ".join(say(60)), "en", "", 0) for i in range(600)]
    labels = [(i, 1, 0) for i in range(600)]
    for i in range(600, 900):
        w = say(60)
        w[30:30] = ["you", "zorgo"]
        docs.append((i, " ".join(w), "en", "", 0))
        labels.append((i, 1, 1))
    copy = " ".join([*say(20), "vilest", "scummy", "trashy", *say(20)])
    docs += [(i, copy, "en", "", 0) for i in range(900, 1000)]
    labels += [(i, 1, 1) for i in range(900, 1000)]
    got = toxicity.toxicity(spark.createDataFrame(docs, DDL), spark.createDataFrame(labels, LABELS)).collect()
    held = [x for x in got if x.held_out]
    slur = [x.predicted for x in held if 600 <= x.doc_id < 900]
    assert len(slur) > 50 and sum(slur) / len(slur) > 0.95
    assert sum(x.predicted for x in held if x.doc_id < 600) <= 2


def test_no_labels_or_one_class(spark):
    d = spark.createDataFrame(corpus(10), DDL)
    assert {x.score for x in toxicity.toxicity(d, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert {x.score for x in toxicity.toxicity(d, spark.createDataFrame([(i, 1, 0) for i in range(10)], LABELS)).collect()} == {0.0}
    assert toxicity.toxicity(spark.createDataFrame([], DDL), spark.createDataFrame([(1, 1, 1)], LABELS)).count() == 0


def brute_segments(s):
    """All maximal segments, by definition: recursively the best segment, then what lies beside it."""
    best, at = 0.0, None
    for i in range(len(s)):
        t = 0.0
        for j in range(i, len(s)):
            t += s[j]
            if t > best + 1e-12:
                best, at = t, (i, j + 1)
    if at is None:
        return []
    a, b = at
    left, right = brute_segments(s[:a]), brute_segments(s[b:])
    return left + [(a, b, best)] + [(b + x, b + y, z) for x, y, z in right]


def test_maximal_segments_match_definition():
    r = random.Random(7)
    for _ in range(300):
        s = [round(r.uniform(-2, 2), 3) for _ in range(r.randrange(1, 14))]
        got = toxicity.maximal_segments(list(range(len(s))), s, 0.0)
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))
