import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenforge.llm import exact_dedup, simhash_dedup as sd
from lumenforge.operators.components import components

DDL = "doc_id long, text string, keep_id string, hash int"


def test_exact_matches_brute_force(spark):
    r = random.Random(5)
    docs = [(i * 13 % 401, r.choice(["Ab é", "aB é", "ab É", "", "zz " * 500, f"own {i}"]), "x", 1) for i in range(400)] + [(900, None, None, None), (None, "only", "", 1), (None, "Ab é", "", 1), (7, "Ab é", "", 0)]
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    group = {}
    for i, t, *_ in docs:
        group.setdefault(low(t), []).append(i)
    want = []
    for i, t, *_ in docs:
        g = group[low(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    for cap in (8 << 20, 300):
        got = [tuple(x) for x in exact_dedup.exact_duplicates(spark.createDataFrame(docs, DDL), capacity=cap).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], DDL)).count() == 0


def test_collisions_are_chained(spark, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda x: 1 << 63)
    rows = [(i, i << 40, 5, "s", i << 40, (b"a", b"b")[i % 2]) for i in range(6)]
    index = spark.createDataFrame([(r, d, h, s, r, t) for d, r, h, s, l, t in rows], exact_dedup.INDEX.replace("doc_id", "doc_id"))
    got = dict(map(tuple, exact_dedup.owners(index).collect()))
    assert got == {i << 40: (i % 2) << 40 for i in range(6)}


def test_directory_doubles_where_buckets_are_overfull(spark):
    """Buckets of several hashes hold their capacity at most, a hash is in one bucket, and buckets don't overlap."""
    r = random.Random(8)
    keys = [(r.randrange(1 << 63) - (1 << 62), 10) for _ in range(600)] + [((1 << 61) + (i << 44), 10) for i in range(200)] + [(77, 5000)]
    got = dict(map(tuple, exact_dedup.directory(spark.createDataFrame(keys, "hash long, weight long"), 200).collect()))
    assert set(got) == {k for k, _ in keys}
    weight, low = {}, {}
    for k, w in keys:
        weight[got[k]] = weight.get(got[k], 0) + w
        low.setdefault(got[k], []).append(k)
    assert all(w <= 200 or len(low[s]) == 1 for s, w in weight.items())
    spans = sorted((min(v), max(v)) for v in low.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert len({s.bit_length() for s in weight}) > 3  # several depths
    assert exact_dedup.directory(spark.createDataFrame([], "hash long, weight long"), 200).count() == 0


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(ids, linked):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_exact_mode_matches_brute_force(spark):
    r = random.Random(2)
    base = [f"w{r.randrange(50)}" for _ in range(400)]
    docs = []
    for i in range(150):
        w = list(base) if i % 3 else [f"w{r.randrange(50)}" for _ in range(r.randrange(6))]
        for _ in range(i % 4):
            if w:
                w[r.randrange(len(w))] = f"v{r.randrange(9)}"
        docs.append((i * 7 % 151, " ".join(w), "", 1))
    docs += [(500, None, "", 1), (501, " \t", "", 1), (None, "x", "", 1), (3, docs[0][1], "", 2)]
    got = sd.near_duplicates(spark.createDataFrame(docs, DDL), 3, 1, 3).collect()
    assert len(got) == len(docs)
    for fine in (1, 2):
        assert sorted(map(tuple, sd.near_duplicates(spark.createDataFrame(docs, DDL), 3, 1, 3, fine=fine).collect()), key=str) == sorted(map(tuple, got), key=str)
    fp = {i: brute_print(t) for i, t, *_ in docs}
    for x in got:
        if x.doc_id != 3:
            assert int.from_bytes(x.print, "little") == fp[x.doc_id]
    prints = {}
    for i, t, *_ in docs:
        if i is not None:
            prints.setdefault(i, []).append(brute_print(t))
    want = classes(list(prints), lambda a, b: any((p ^ q).bit_count() <= 3 for p in prints[a] for q in prints[b]))
    assert {x.doc_id: x.component_id for x in got if x.doc_id not in (None,)} == want
    assert len(set(want.values())) < 120


def test_every_pair_within_three_bits_shares_a_key():
    r = np.random.default_rng(0)
    for _ in range(300):
        a = r.integers(0, 2**63, 1, dtype=np.uint64)
        b = a.copy()
        for k in r.integers(0, 64, 3):
            b ^= np.uint64(1) << np.uint64(k)
        for fine, n in ((0, 8), (1, 24), (2, 96)):
            keys = sd.ring_keys(np.array([a, b]).reshape(2, 1), fine=fine)
            assert len(keys) == n and any(k[0] == k[1] and sd.viable(a, b.reshape(1, 1), int(k[0] >> sd.START), 3)[0] for k in keys)


@pytest.mark.parametrize("edits,low", [(1, 0.99), (4, 0.9)])
def test_similarity_mode_finds_near_copies(spark, edits, low):
    r = random.Random(9)
    rand = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    docs, pairs = [], []
    for i in range(100):
        w = rand(200)
        v = list(w)
        for _ in range(edits):
            v[r.randrange(200)] = "zz"
        docs += [(2 * i, " ".join(w), "", 1), (2 * i + 1, " ".join(v), "", 1)]
    docs += [(1000 + i, " ".join(rand(150)), "", 1) for i in range(100)] + [(2000, "", "", 1), (2001, None, "", 1), (None, "a b", "", 0)]
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(spark.createDataFrame(docs, DDL)).collect()}
    assert sum(got[2 * i + 1] == 2 * i for i in range(100)) >= 100 * low
    assert all(got[1000 + i] == 1000 + i for i in range(100)) and got[2001] == 2001 and got[None] is None
    assert all(got[2 * i] == 2 * i for i in range(100))


def test_components(spark):
    r = random.Random(1)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)]
    want = classes(sorted({x for p in e for x in p}), lambda a, b, s=set(e): (a, b) in s or (b, a) in s)
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    lone = {a for a, b in e if a == b}
    assert {k: v for k, v in want.items() if k in got} == got and set(want) - set(got) <= lone
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similarity_mode_recall_at_the_threshold():
    """Pairs at a Jaccard similarity of five-word shingles of 0.8 or more share a key and link, nine of ten at least; at 0.6 or less, none."""
    r = random.Random(3)

    def jaccard(a, b):
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        return len(x & y) / len(x | y)

    words, chain, limit = sd.WORDS, sd.CHAIN, sd.SENT * sd.LOOSE
    near, far = [], []
    for t in range(160):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        v, goal = list(w), r.choice([0.8, 0.85, 0.9, 0.58])
        while jaccard(w, v) > goal + 0.02:
            v[r.randrange(300)] = f"z{r.randrange(9999)}"
        p = np.array([sd.fingerprint(sd.shingle_hashes(" ".join(x).encode(), 5), words) for x in (w, v)])
        linked = any(k[0] == k[1] for k in sd.ring_keys(p, chain)) and sd.distance(p[0, : sd.SENT], p[1:, : sd.SENT])[0] <= limit
        j = jaccard(w, v)
        (near if j >= 0.8 else far if j <= 0.6 else []).append(bool(linked))
    assert len(near) > 60 and sum(near) / len(near) >= 0.9
    assert len(far) > 20  # candidates at most; their sets decide


def shingle_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similarity_mode_verifies_candidates_by_their_shingle_sets(spark):
    """A phrase repeated in two texts is one shingle set's share; pairs below 0.8 stay apart, pairs from 0.8 on link."""
    r = random.Random(21)
    rand = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    line = " ".join(["all rights are reserved here"] * 60)
    docs = [(i, f"{' '.join(rand(300))} {line}", "", 1) for i in range(20)]
    goals = [0.72, 0.76, 0.78, 0.85, 0.9]
    for i in range(60):
        w = rand(300)
        v, goal = list(w), goals[i % 5]
        while shingle_jaccard(" ".join(w), " ".join(v)) > goal:
            v[r.randrange(300)] = f"z{r.randrange(9999)}"
        docs += [(1000 + 2 * i, " ".join(w), "", 1), (1001 + 2 * i, " ".join(v), "", 1)]
    text = {i: t for i, t, *_ in docs}
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(spark.createDataFrame(docs, DDL)).collect()}
    assert all(got[i] == i for i in range(20))
    pairs = [(1000 + 2 * i, 1001 + 2 * i) for i in range(60)]
    high = [p for p in pairs if shingle_jaccard(text[p[0]], text[p[1]]) >= 0.8]
    assert 20 <= len(high) < 60 and sum(got[b] == a for a, b in high) >= 0.95 * len(high)
    assert all(got[b] == b for a, b in pairs if (a, b) not in high)


def test_links_of_similar_sets_match_brute_force():
    r = random.Random(5)
    base = [r.sample(range(200), 40) for _ in range(6)]
    sets = [np.unique(np.array([x if r.random() > 0.08 else r.randrange(200) for x in base[k % 6]], np.uint64)) for k in range(60)]
    jac = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    got = set(sd.similar(np.arange(60), sets, 0.8))
    want = classes(list(range(60)), lambda a, b: jac(a, b) >= 0.8)
    assert all(jac(a, b) >= 0.8 for a, b in got) and len(got) < 60
    assert classes(list(range(60)), lambda a, b: (a, b) in got or (b, a) in got) == want


def test_recall_on_the_drivers_near_copies(spark):
    """Of all pairs at a similarity of 0.8 or more, found by an inverted index, nine of ten at least end in one group; no group joins others."""
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    sets = {i: set(sd.shingle_hashes((t or "").encode(), 5).tolist()) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for h in s:
            where.setdefault(h, []).append(i)
    pairs = set()
    for i, s in sets.items():
        both = {}
        for h in s:
            for j in where[h]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        pairs |= {(i, j) for j, n in both.items() if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9}
    want = classes(sorted({x for p in pairs for x in p}), lambda a, b: (a, b) in pairs)
    got = {x.doc_id: x.component_id for x in sd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(pairs) > 50 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[i] == i for i in got if i not in want)
    assert all(want[i] == want[got[i]] for i in want)


def test_stages_tell_rows_apart_by_text(spark):
    """Repeated and null ids, clashing columns: what goes is what the classes say, row by row."""
    long = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(3)]
    near = long[0] + " more"
    docs = [(5, "a b c", 1), (5, "x y z", 1), (9, "A b c", 2), (None, "q", 1), (None, "q", 1), (None, "a b c", 1), (20, long[0], 0), (20, long[1], 0), (8, near, 0), (None, long[1], 0), (None, long[2], 3), (None, None, 0), (4, "", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, kept_id int").withColumns({k: F.lit(1) for k in ("key", "row", "d", "k", "gone_d", "gone_k", "same", "node", "component", "rep")})
    got = exact_dedup.without_duplicates(d)
    assert got.columns == d.columns
    out = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    gone = [(5, "a b c"), (None, "a b c"), (None, long[1]), (None, None)]
    assert out == sorted([r[:2] for r in docs if r[:2] not in gone], key=str)
    kept = [x for x in exact_dedup.exact_duplicates(d).collect() if x.kept]
    assert sorted(str(x.doc_id) for x in kept) == sorted(str(i) for i, _ in out)
    got = sd.without_near_duplicates(d)
    assert got.columns == d.columns
    out = sorted(((x.doc_id, x.text) for x in got.collect()), key=str)
    gone = [(9, "A b c"), (None, "a b c"), (20, long[0]), (None, long[1])]
    assert out == sorted([r[:2] for r in docs if r[:2] not in gone], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string, kept_id int")
    assert exact_dedup.without_duplicates(empty).count() == sd.without_near_duplicates(empty).count() == 0
