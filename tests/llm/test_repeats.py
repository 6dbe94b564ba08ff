import hashlib
import random

import numpy as np
import pytest

from lumenforge.llm import recompression, repeats, suffix_order
from lumenforge.llm.substring_dedup import drop_repeated_words
from lumenforge.llm.suffix_dedup import drop_repeated_bytes

DDL = "doc_id long, text string, n_words string, batch long"


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "c", "déf", "gh", "i", "日本", "kl", "m"]
    rand = lambda n: " ".join(r.choice(words) + str(r.randrange(9)) for _ in range(n))
    common, line = rand(40), rand(14)
    docs = []
    for i in range(60):
        k = i % 6
        text = {0: rand(30), 1: common, 2: rand(9) + " " + line + "\n" + rand(20), 3: rand(5) + " " + common[: r.randrange(40, 120)] + " " + rand(4), 4: "x " * r.randrange(60), 5: "a" * r.randrange(120)}[k]
        docs.append((i * 7 % 61, text, "n", 1))
    docs += [(200, None, None, None), (201, "", "", 1), (202, rand(3000), "", 2), (3, common, "", 1), (None, common, "", 1), (203, docs[-5][1], "", 1)]
    return docs


def least(docs, units, n):
    seen = {}
    for i, t, *_ in docs:
        u = units(t)
        for p in range(len(u) - n + 1):
            k = tuple(u[p : p + n]) if isinstance(u, list) else u[p : p + n]
            v = repeats.NONE if i is None else i
            seen[k] = min(seen.get(k, v), v)
    return seen


def brute(docs, units, n):
    seen = least(docs, units, n)
    for i, t, *_ in docs:
        u = units(t)
        gone = [False] * len(u)
        for p in range(len(u) - n + 1):
            k = tuple(u[p : p + n]) if isinstance(u, list) else u[p : p + n]
            if seen[k] < (repeats.NONE if i is None else i):
                gone[p : p + n] = [True] * n
        yield i, u, gone


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    docs = corpus(seed)
    got = sorted(map(tuple, drop_repeated_words(spark.createDataFrame(docs, DDL), batch_bytes=3000, slot_bytes=2000).collect()), key=str)
    want = sorted(((i, len(u), sum(g), hashlib.sha256(b" ".join(x for x, k in zip(u, g) if not k)).hexdigest()) for i, u, g in brute(docs, lambda t: (t or "").encode().split(), 13)), key=str)
    assert got == want
    assert sum(x[2] for x in got) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed):
    docs = corpus(seed)
    got = sorted(map(tuple, drop_repeated_bytes(spark.createDataFrame(docs, DDL), batch_bytes=3000, slot_bytes=2000).collect()), key=str)
    want = []
    for i, u, g in brute(docs, lambda t: (t or "").encode(), 50):
        runs = sum(1 for a, b in zip([False, *g], g) if b and not a)
        want.append((i, len(u), sum(g), runs, hashlib.sha256(bytes(x for x, k in zip(u, g) if not k)).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(x[2] for x in got) > 100


def test_equal_names_are_told_apart(spark, monkeypatch):
    """With names that collide, bytes and words decide."""
    docs = corpus(3)
    real = repeats.names

    def weak(sym, length):
        return real(sym, length) & np.uint64(0xF00)

    monkeypatch.setattr(repeats, "names", weak)
    monkeypatch.setattr(recompression, "names", weak)
    for f, units, n in ((drop_repeated_bytes, lambda t: (t or "").encode(), 50), (drop_repeated_words, lambda t: (t or "").encode().split(), 13)):
        got = {r.doc_id: r.n_removed for r in f(spark.createDataFrame(docs, DDL)).collect() if r.doc_id not in (3, None)}
        assert got == {i: sum(g) for i, _, g in brute(docs, units, n) if i not in (3, None)}


def test_order_of_windows_with_one_name(monkeypatch):
    monkeypatch.setattr(recompression, "names", lambda sym, n: np.zeros(len(sym) - n + 1, np.uint64))
    m = recompression.Recompression(3, 2)
    sym = m.load([b"a b c a b c a b", b"b c a x"])
    at = np.array([0, 1, 2, 3, 4, 5, 8, 9])
    order, new = m.order(sym, at)
    rows = [tuple(sym[at[i] : at[i] + 3].tolist()) for i in order]
    assert new.tolist() == [True] + [x != y for x, y in zip(rows, rows[1:])] and sum(new) == len(set(rows))


def test_chunks_and_empty(spark, monkeypatch):
    docs = corpus(4)
    monkeypatch.setattr(repeats, "CHUNK", 128)
    monkeypatch.setattr(recompression, "CHUNK", 64)
    got = {r.doc_id: r.n_removed for r in drop_repeated_words(spark.createDataFrame(docs, DDL)).collect() if r.doc_id not in (3, None)}
    assert got == {i: sum(g) for i, _, g in brute(docs, lambda t: (t or "").encode().split(), 13) if i not in (3, None)}
    got = {r.doc_id: r.n_removed for r in drop_repeated_bytes(spark.createDataFrame(docs, DDL)).collect() if r.doc_id not in (3, None)}
    assert got == {i: sum(g) for i, _, g in brute(docs, lambda t: (t or "").encode(), 50) if i not in (3, None)}
    assert drop_repeated_words(spark.createDataFrame([], DDL)).count() == 0
    assert drop_repeated_bytes(spark.createDataFrame([], DDL)).count() == 0


def test_names_depend_on_the_run_alone():
    x = np.random.default_rng(0).integers(0, 4, 500).astype(np.uint8)
    for n in (1, 2, 3, 13, 24, 50):
        h = repeats.names(x, n)
        assert len(h) == 500 - n + 1
        by = {}
        for i in range(len(h)):
            assert by.setdefault(x[i : i + n].tobytes(), h[i]) == h[i]
        assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("letters,seed", [(2, 1), (3, 2), (50, 3)])
def test_equal_windows_stay_together(monkeypatch, letters, seed):
    """Windows that two documents have survive every round, under one name wherever they stand and wherever a chunk ends."""
    r = np.random.default_rng(seed)
    parts = [r.integers(0, letters, k) for k in (40, 300, 13, 5, 200)]
    parts += [np.concatenate([p[3:], parts[1][20:90], p[:7]]) for p in parts] + [np.repeat(parts[0][:3], 20)]
    texts = [b" ".join(b"w%d" % x for x in p.tolist()) for p in parts]
    where = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - 12):
            where.setdefault(tuple(w[i : i + 13]), set()).add(d)
    for chunk in (1 << 19, 64):
        monkeypatch.setattr(recompression, "CHUNK", chunk)
        m = recompression.Recompression(13, 2)
        own, shared = m.prepare(texts), []
        for _ in range(m.rounds):
            g, at = m.propose(own, shared)
            doc = np.searchsorted(own.bounds, at, "right")
            shared.append(np.array(sorted(x for x in set(g.tolist()) if len(set(doc[g == np.uint64(x)].tolist())) > 1), np.uint64))
        start, count, name = m.segments(own, shared)
        at = repeats.spread(start, count)
        key = np.repeat(name, count)
        words, seen = b" ".join(texts).split(), {}
        for i, k in zip(at.tolist(), key.tolist()):
            assert seen.setdefault(tuple(words[i : i + 13]), k) == k
            assert m.cut(own, i, 13).split() == words[i : i + 13]
        assert {w for w, d in where.items() if len(d) > 1} <= set(seen)
        assert len(set(at.tolist())) == len(at)


def test_words_and_their_names(monkeypatch):
    """Words are what split() gives, in any slices; equal words alone have equal names."""
    r = random.Random(2)
    texts = [bytes(r.choice(b"ab\xc3\xa9 \t\n\v\f\r") for _ in range(r.randrange(60))) for _ in range(40)] + [b"", b" ", b"x" * 5000]
    for size in (1 << 17, 3):
        monkeypatch.setattr(recompression, "SLICE", size)
        w = recompression.Words(texts)
        got = [w.text[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
        assert got == [x for t in texts for x in t.split()]
        assert np.diff(w.bounds).tolist() == [len(t.split()) for t in texts]
        names = dict(zip(got, w.sym.tolist()))
        assert [names[x] for x in got] == w.sym.tolist() and len(set(names.values())) == len(names)


@pytest.mark.parametrize("bucket", [1 << 20, 16])
def test_suffixes_stand_in_order(monkeypatch, bucket):
    """Against plain sorting, over few and many letters, repeated stretches and buckets of any size."""
    monkeypatch.setattr(suffix_order, "BUCKET", bucket)
    r = np.random.default_rng(7)
    for trial in range(30):
        t = r.integers(0, int(r.choice([1, 2, 3, 30])), int(r.integers(60, 700))).astype(np.uint8)
        if trial % 2:
            t = np.concatenate([t, t[10:200], t[:55], t[3:]])
        at = np.sort(r.choice(len(t) - 49, size=int(r.integers(1, len(t) - 48)), replace=False))
        order, new = suffix_order.suffix_order(t, at, 50)
        s = [t[i : i + 50].tobytes() for i in at[order]]
        assert sorted(order.tolist()) == list(range(len(at))) and s == sorted(s)
        assert new.tolist() == [True] + [a != b for a, b in zip(s, s[1:])]
