import random

from lumenforge.llm import decontaminate as dc

DDL = "doc_id long, text string, item_id int, similarity string"


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_matches_table():
    r = random.Random(1)
    for _ in range(200):
        a = [r.randrange(1, 6) for _ in range(r.randrange(1, 15))]
        b = [r.randrange(0, 6) for _ in range(r.randrange(0, 25))]
        assert dc.lcs(a, b) == lcs(a, b)


def world(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8))) for _ in range(3000)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(r.randrange(10, 50)))) for i in range(30)]
    docs = [(i, " ".join(say(r.randrange(50, 400)))) for i in range(200)]
    planted = {}
    for k in range(40):
        item, text = items[k % 30]
        w = text.split()
        if k % 2:  # a paraphrase: some words replaced
            for _ in range(len(w) // 8):
                w[r.randrange(len(w))] = r.choice(vocab)
        d = docs[k][1].split()
        at = r.randrange(len(d))
        docs[k] = (k, " ".join(d[:at] + w + d[at:]))
        planted[k] = item
    return items, docs, planted


def test_planted_items_are_found_and_no_others(spark):
    items, docs, planted = world()
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DDL)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()}
    assert len([1 for k, v in planted.items() if (k, v) in got]) >= 38
    assert {k for k, _ in got} <= set(planted)
    kept = {x.doc_id for x in dc.without_benchmark(d, b).collect()}
    assert kept == {i for i, _ in docs} - {k for k, _ in got}
    blocked = {(x.doc_id, x.item_id) for x in dc.contaminated(d, b, block=7).collect()}
    assert len([1 for k, v in planted.items() if (k, v) in blocked]) >= 38 and {k for k, _ in blocked} <= set(planted)


def test_defined_cases(spark):
    items, docs, planted = world()
    text = items[0][1]
    rows = [(None, text, 1, ""), (1, None, 1, ""), (2, "", 1, ""), (3, text, 1, ""), (3, text, 1, ""), (4, "x " * 40_000 + text + " y" * 40_000, 1, "")]
    b = spark.createDataFrame([(0, text), (1, None), (None, "a"), (2, ""), (3, "!!")], "item_id long, text string")
    d = spark.createDataFrame(rows, DDL)
    got = [x.doc_id for x in dc.contaminated(d, b).collect()]
    assert sorted(got, key=str) == sorted([None, 3, 3, 4], key=str)
    assert sorted(x.doc_id for x in dc.without_benchmark(d, b).collect()) == [1, 2]
    assert dc.contaminated(spark.createDataFrame([], DDL), b).count() == 0
    assert dc.contaminated(d, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert dc.without_benchmark(d, spark.createDataFrame([], "item_id long, text string")).count() == 6


def test_short_items_must_occur_word_by_word(spark):
    b = spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x alpha beta gamma delta y", 0, ""), (2, "alpha x beta gamma x delta", 0, ""), (3, "delta gamma beta alpha", 0, "")], DDL)
    assert [x.doc_id for x in dc.contaminated(d, b).collect()] == [1]


def test_verbatim_items_are_found_whatever_their_cosine(spark):
    """Short items amid words of other items, which outweigh them in every window; words in another order don't count."""
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    plain = ["of", "in", "to", "and", "or", "at", "by", "on", "so"]
    items = [(i, " ".join(say(30))) for i in range(40)]
    items += [(100 + i, " ".join(r.sample(plain, n))) for i, n in enumerate([4, 5, 6, 7, 4, 5, 6, 7])]
    items += [(200, " ".join(r.sample(plain, 9))), (201, "single")]
    docs, want = [], set()
    for i in range(300):
        w = say(r.randrange(60, 200))
        for _ in range(len(w) // 6):  # plain words are common
            w[r.randrange(len(w))] = r.choice(plain)
        if i % 3 == 0:
            at = r.randrange(len(w))
            w[at:at] = items[40 + i // 3 % 10][1].split()
        docs.append((i, " ".join(w), 0, ""))
    docs += [(900, " ".join(["x"] * 18 + ["of", "in"]), 0, ""), (901, "to and", 0, "")]
    items += [(300, "of in to and")]  # ends of one text and head of the next don't make it
    short = [(k, f" {t} ") for k, t in items if len(t.split()) < 10]
    want = {(i, k) for i, t, *_ in docs for k, s in short if s in f" {t} "}
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, DDL).coalesce(1)
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(d, b).collect()}
    exact = {k for k, s in short if len(s.split()) < 8}
    assert len(want) >= 100 and want <= got
    assert {x for x in got if x[1] in exact} == {x for x in want if x[1] in exact}


def test_paraphrases_in_the_drivers_documents(spark):
    """Items with a ninth of their words replaced, put into documents of the driver's tables: nine of ten found at least, and no document flagged for an item that is not in it."""
    sf, r = "/root/testdata/sf0.001", random.Random(17)
    docs = [(x.doc_id, x.text or "") for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    items = [(x.item_id, x.text) for x in bench.collect() if len(dc.words_of(x.text)) >= 12]
    before = {(x.doc_id, x.item_id) for x in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    vocabulary = sorted({w for _, t in docs for w in t.split()})
    clean = [d for d, t in docs if len(t.split()) >= 40 and d not in {x for x, _ in before}]
    want = set()
    text = dict(docs)
    for d, (k, t) in zip(r.sample(clean, min(len(clean), 2 * len(items))), items * 2):
        w = t.split()
        for _ in range(max(1, len(w) // 9)):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        body = text[d].split()
        at = r.randrange(len(body))
        text[d] = " ".join([*body[:at], *w, *body[at:]])
        want.add((d, k))
    got = {(x.doc_id, x.item_id) for x in dc.contaminated(spark.createDataFrame(list(text.items()), "doc_id long, text string"), bench).collect()}
    assert len(want) >= 50 and len(want & got) >= 0.9 * len(want), (len(want), len(want & got))
    assert len(got - want - before) <= 0.02 * len(want)
