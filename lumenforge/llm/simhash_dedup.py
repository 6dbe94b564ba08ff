"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into segments around a ring.  If two fingerprints differ in at most
T of their bits, some start has every chain of consecutive segments from it within its
share of T (l of m segments: at most T * l / m), not one segment alone.

* Exact mode (``words`` = 1): 64 bits, 4 segments, T = 3.  From that start the first
  segment is equal and the second differs in at most one bit, so one of its halves is equal:
  24 bits of an index key, 8 keys a fingerprint, and no pair is missed.  Of three segments at most two bits
  differ, of all four three: a third of the third segment, and a quarter of the fourth, are equal, which gives
  keys of 29 and 33 bits for more documents (24 and 96 a fingerprint; the links are the same, chance members of a key
  stay few).  Chains of two and three segments are checked before the full Hamming distance.
* Similarity mode: at a Jaccard similarity of 0.8 a tenth to a sixth of
  the bits differ, which no index of 64 bits finds.  23 fingerprints of the shingles' mixed
  hashes form a ring of 1,472 bits in 294 segments of 5; a key is a chain of five consecutive
  segments without a difference (25 bits, 294 keys).  A pair at 0.8 has 4.9 such chains
  on average.  Keys are followed by the first four fingerprints only; a pair within the
  limit of differing bits in these is a candidate, no more.  The members of
  each group that candidates connect bring their sets of distinct shingles together, and a
  pair links if the Jaccard similarity of the two sets is 0.8 or more.  One design serves every size.

Each batch of fingerprints first sends its distinct keys alone; the owner of a slot of
keys marks those that two fingerprints have, and fingerprints follow for these only.  The
owner then links the fingerprints of a key by search from one to all not yet reached: a
group of near copies costs about its size, and all keys of a slot together give at most one link a member.  Equal
fingerprints (in similarity mode equal sets of shingles) are merged before: they are one node.

Defined cases: null text counts as empty; no words: fingerprint zero, linked as any other
in exact mode; in similarity mode texts without words stay alone.  In ``near_duplicates`` a null doc_id is not
linked (its component is null), and rows with one doc_id are one document and link each other.  In
``without_near_duplicates`` each row stands for itself: of a group the row of least doc_id stays (null after all
others; of one doc_id the text of least digest), and rows alike in doc_id and text stay or go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import parts, stored, without_rows
from ..operators.components import components
from .repeats import arrow_schema, opened, squeezed

MIX = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1) for i in range(256)]
LINKS = "a long, b long"
WORDS, CHAIN = 23, 5  # of similarity mode
SENT = 4  # words of a fingerprint that follow a key in similarity mode
LOOSE = 14  # bits of 64 in which candidates may differ: 22 %, where a pair at 0.8 differs in 15 %
KEYS = "slot long, batch long, keys binary, ids binary, prints binary"


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the lower-cased words, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= shingle:
        return np.array([digest(b" ".join(w), 42)], np.uint64)
    if shingle == 3:
        return np.array([digest(b"%b %b %b" % x, 42) for x in zip(w, w[1:], w[2:], strict=False)], np.uint64)
    return np.array([digest(b" ".join(x), 42) for x in zip(*(w[i:] for i in range(shingle)), strict=False)], np.uint64)


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    """A bit is 1 where it is set in over half of the hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(h) else 0):
        x = h
        if k:
            x = h * MIX[k]
            x ^= x >> np.uint64(29)
            x *= MIX[0]
            x ^= x >> np.uint64(32)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            ones += np.unpackbits(x[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def digest(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, key, print, the fingerprint's 8 * words bytes (null in similarity mode if there is no word), and same,
    a digest of what is merged: the print, in similarity mode the set of shingles, each of which counts once there.
    """

    def run(batches):
        import xxhash

        for b in batches:
            got, same = [], []
            for t in b.column("text").to_pylist():
                h = shingle_hashes((t or "").encode(), shingle)
                if words > 1:
                    h = np.unique(h)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                got.append(None if words > 1 and not len(h) else fingerprint(h, words).tobytes())
            cols = [b.column("doc_id"), b.column("key"), pa.array(got, pa.binary())]
            yield pa.record_batch([*cols, pa.array(same, pa.binary()) if words > 1 else cols[-1]], names=["doc_id", "key", "print", "same"])

    key = digest(F.col("text")) if words > 1 else F.lit("")
    return parts(docs).select("doc_id", "text", key.alias("key")).mapInArrow(run, "doc_id long, key string, print binary, same binary")


START = np.uint64(60)  # where a key of exact mode holds its first segment's number
THIRDS, QUARTERS = ((0, 6), (6, 5), (11, 5)), ((0, 4), (4, 4), (8, 4), (12, 4))


def ring_keys(p: np.ndarray, chain: int = 4, fine: int = 0) -> list[np.ndarray]:
    """Index keys of fingerprints (n x words): for each kind of key, one for each fingerprint.

    fine: in exact mode, how many segments beyond the second lend bits to the key.
    """
    out = []
    if p.shape[1] == 1:
        seg = [(p[:, 0] >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(4)]
        take = lambda x, at, n: (x >> np.uint64(at)) & np.uint64((1 << n) - 1)
        for i in range(4):
            own = [(seg[i] << np.uint64(8)) | take(seg[(i + 1) % 4], 8 * half, 8) for half in range(2)]
            for step, cuts in ((2, THIRDS), (3, QUARTERS))[:fine]:
                own = [(bits << np.uint64(6)) | take(seg[(i + step) % 4], at, n) for bits in own for at, n in cuts]
            out += [np.uint64(i << 60 | kind << 48) | bits for kind, bits in enumerate(own)]
        return out
    bits = np.unpackbits(p.view(np.uint8).reshape(len(p), -1), axis=1, bitorder="little")
    n = bits.shape[1] // 5
    seg = (bits[:, : 5 * n].reshape(len(p), n, 5) @ np.array([1, 2, 4, 8, 16], np.uint8)).astype(np.uint64)
    for i in range(n):
        k = np.full(len(p), i, np.uint64)
        for j in range(chain):
            k = (k << np.uint64(5)) | seg[:, (i + j) % n]
        out.append(k)
    return out


def distance(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ one).sum(axis=1, dtype=np.int64)


def viable(one: np.ndarray, others: np.ndarray, start: int, limit: int) -> np.ndarray:
    """Which of others keep within the budgets of the chains of two and three segments from start."""
    x = (others ^ one)[:, 0]
    two = np.uint64(sum(0xFFFF << (16 * ((start + j) % 4)) for j in range(2)))
    three = np.uint64(sum(0xFFFF << (16 * ((start + j) % 4)) for j in range(3)))
    return (np.bitwise_count(x & two) <= limit * 2 // 4) & (np.bitwise_count(x & three) <= limit * 3 // 4)


def link_group(ids: np.ndarray, p: np.ndarray, limit: int, start: int | None) -> list[tuple[int, int]]:
    """Links that connect the members of one key as all links within ``limit`` do: one a member at most."""
    rest, out = np.arange(len(ids)), []
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            near = np.zeros(len(rest), bool)
            for at in range(0, len(rest), 1 << 16):
                part = rest[at : at + (1 << 16)]
                ok = np.arange(len(part)) if start is None else np.flatnonzero(viable(p[i], p[part], start, limit))
                near[at + ok] = distance(p[i], p[part[ok]]) <= limit
            got = rest[near].tolist()
            out += [(int(ids[i]), int(ids[j])) for j in got]
            todo += got
            rest = rest[~near]
    return out


def similar(ids: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect the sets as all pairs with a Jaccard similarity of ``least`` or more do: one a set at most."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    off = np.append(0, np.cumsum(size))
    _, sym = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.repeat(np.arange(n), size)[np.argsort(sym, kind="stable")]  # the sets that have each shingle, one shingle after another
    count = np.bincount(sym)
    head = np.cumsum(count) - count
    left, rest, out = np.ones(n, bool), n, []
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        rest -= 1
        todo = [seed]
        while todo and rest:
            i = todo.pop()
            own = sym[off[i] : off[i + 1]]
            c = count[own]
            at = np.arange(int(c.sum())) + np.repeat(head[own] - (np.cumsum(c) - c), c)
            both = np.bincount(has[at], minlength=n)
            got = np.flatnonzero(left & (both >= least * (size[i] + size - both) - 1e-9))
            left[got] = False
            rest -= len(got)
            out += [(int(ids[i]), int(ids[j])) for j in got.tolist()]
            todo += got.tolist()
    return out


def verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between nodes(node, rep: doc_id and key of a row) that candidates(a, b) connect and whose sets of shingles are similar."""
    groups = components(candidates).join(nodes.select("node", "rep.*"), "node").select("node", "component", F.col("doc_id").alias("d"), F.col("key").alias("k"))
    d = parts(docs).withColumn("key", digest(F.col("text")))
    texts = d.join(groups, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("component", F.col("node").alias("doc_id"), "text")

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes((t or "").encode(), shingle)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("component"), b.column("doc_id"), pa.array(sets, pa.binary())], names=["component", "id", "shingles"])

    def check(table):
        seen: dict[tuple[int, bytes], None] = dict.fromkeys(zip(table.column("id").to_pylist(), table.column("shingles").to_pylist(), strict=True))
        rows = [(i, x) for i, x in sorted(seen) if x]
        out = similar(np.array([i for i, _ in rows]), [np.frombuffer(x, np.uint64) for _, x in rows], least) if rows else []
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return texts.mapInArrow(run, "component long, id long, shingles binary").groupBy("component").applyInArrow(check, LINKS)


def _rows(rows: list[tuple]) -> pa.Table:
    schema = arrow_schema(KEYS)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def links(prints: DataFrame, words: int, limit: int, slots: int, chain: int = 4, sent: int | None = None, fine: int = 0) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of prints(id, print), by the distance of the first ``sent`` words (all)."""
    sent = sent or words

    def by_slot(table):
        """Ids, fingerprints, and by slot: sorted keys and the places of their fingerprints."""
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        p = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(-1, words)
        ids, p = ids[order], p[order]
        k = np.concatenate(ring_keys(p, chain, fine))
        at = np.tile(np.arange(len(ids)), len(k) // max(1, len(ids)))
        s = ((k * MIX[0]) >> np.uint64(40)) % np.uint64(slots)
        order = np.lexsort((k, s))
        k, at, s = k[order], at[order], s[order]
        cut = np.flatnonzero(np.diff(s)) + 1
        return ids, p, [(int(s[a]), k[a:b], at[a:b]) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(s)], strict=True) if b > a]

    def find(key, table):
        out = []
        for slot, k, _ in by_slot(table)[2]:
            own, times = np.unique(k, return_counts=True)
            out.append((slot, key[0].as_py(), squeezed(np.diff(own, prepend=np.uint64(0))), squeezed(np.packbits(times > 1)), None))
        return _rows(out)

    def share(key, table):
        came = [np.cumsum(opened(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        twice = [np.unpackbits(opened(x, np.uint8), count=len(k)) for x, k in zip(table.column("ids").to_pylist(), came, strict=True)]
        k, often = np.concatenate(came), np.concatenate(twice).astype(bool)
        order = np.argsort(k, kind="stable")
        new = np.r_[True, k[order][1:] != k[order][:-1]]
        head = np.flatnonzero(new)
        shared = (np.diff(np.append(head, len(k))) > 1) | np.logical_or.reduceat(often[order], head)
        flag = np.empty(len(k), bool)
        flag[order] = shared[np.cumsum(new) - 1]
        out, at = [], 0
        for b, x in zip(table.column("batch").to_pylist(), came, strict=True):
            on = flag[at : at + len(x)]
            at += len(x)
            if on.any():
                out.append((key[0].as_py(), b, squeezed(np.packbits(on)), None, None))
        return _rows(out)

    def send(_, table, marks):
        if not table.num_rows or not marks.num_rows:
            return _rows([])
        ids, p, dealt = by_slot(table)
        mark = dict(zip(marks.column("slot").to_pylist(), marks.column("keys").to_pylist(), strict=True))
        out = []
        for slot, k, at in dealt:
            if slot in mark:
                own, which = np.unique(k, return_inverse=True)
                on = np.unpackbits(opened(mark[slot], np.uint8), count=len(own)).astype(bool)[which]
                out.append((slot, 0, squeezed(np.diff(k[on], prepend=np.uint64(0))), squeezed(ids[at[on]]), p[at[on], :sent].tobytes()))
        return _rows(out)

    def owner(table):
        k = np.concatenate([np.cumsum(opened(x, np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()])
        ids = np.concatenate([opened(x, np.int64) for x in table.column("ids").to_pylist()])
        p = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint64).reshape(-1, sent)
        order = np.lexsort((ids, k))
        out, up = [], {}

        def top(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = i = up.get(j, j)
            return i

        cut = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1], True])
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            i = order[lo:hi]
            if hi - lo < 2 or len({top(x) for x in ids[i].tolist()}) < 2:
                continue
            for a, b in link_group(ids[i], p[i], limit, int(k[i[0]] >> START) if words == 1 else None):
                x, y = top(a), top(b)
                if x != y:  # what other keys of the slot have linked needs no link more
                    up[max(x, y)] = min(x, y)
                    out.append((a, b))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    batches = prints.withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(slots))).groupBy("batch")
    marks = batches.applyInArrow(find, KEYS).groupBy("slot").applyInArrow(share, KEYS)
    shared = batches.cogroup(marks.groupBy("batch")).applyInArrow(send, KEYS)
    return shared.groupBy("slot").applyInArrow(owner, LINKS)


def _nodes(prints: DataFrame) -> DataFrame:
    """node, same, print and rep, the least (doc_id, key) of the rows merged, null after all others."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    rows = prints.where("print is not null").groupBy("same").agg(least.alias("rep"), F.min("print").alias("print"))
    # numbered in the order of ids: the first of a group of copies is then the one that its keys link to, in every slot
    return stored(rows.orderBy("rep").withColumn("node", F.monotonically_increasing_id()), "nodes")


def _similar_groups(docs: DataFrame, prints: DataFrame, shingle: int, similarity: float, more: DataFrame | None = None) -> DataFrame:
    """node, same, rep, group of the nodes of prints in similarity mode."""
    nodes = _nodes(prints)
    slots = max(8, nodes.count() * WORDS // 25_000)
    near = links(nodes.select(F.col("node").alias("id"), "print"), WORDS, SENT * LOOSE, slots, CHAIN, SENT)
    return _grouped(nodes, verified(docs, nodes, near, shingle, similarity), more)


def _grouped(nodes: DataFrame, found: DataFrame, prints: DataFrame | None) -> DataFrame:
    """node, same, rep, group.  prints, if given: rows whose doc_id links them."""
    if prints is not None:
        own = prints.where("print is not null").select("doc_id", "same").distinct().join(nodes.select("same", "node"), "same")
        first = own.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
        found = found.unionAll(own.join(first, "doc_id").select(F.col("node").alias("a"), "b"))
    comp = components(found)
    return nodes.select("node", "same", "rep").join(comp, "node", "left").select("node", "same", "rep", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, shingle: int = 5, words: int | None = None, limit: int | None = None, similarity: float = 0.8, fine: int | None = None) -> DataFrame:
    """doc_id, print, component_id: the least doc_id reachable over links, itself included.

    The defaults link at a Jaccard similarity of the sets of five-word shingles of 0.8 or more; fingerprints
    find the candidates.  shingle=3, words=1, limit=3 is the exact mode, which links by the distance alone;
    fine: see ``ring_keys`` (None: by the number of fingerprints; the links are the same).
    """
    prints = stored(fingerprints(docs, shingle, words or WORDS), "prints")
    linked = prints.where("doc_id is not null")
    if words is None:
        groups = _similar_groups(docs, linked, shingle, similarity, linked)
    else:
        nodes = _nodes(linked)
        n = nodes.count()
        fine = (n > 1 << 24) + (n > 1 << 29) if fine is None else fine
        slots = max(8, n * words * 3**fine // 40_000)
        groups = _grouped(nodes, links(nodes.select(F.col("node").alias("id"), "print"), words, limit, slots, fine=fine), linked)
    groups = stored(groups, "groups")
    least = groups.groupBy("group").agg(F.min("rep.doc_id").alias("c"))
    classes = groups.join(least, "group").select("same", "c")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return prints.join(classes, "same", "left").select("doc_id", "print", own.alias("component_id"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, less those whose group of near copies has another that stays."""
    prints = stored(fingerprints(docs, shingle, WORDS), "prints")
    groups = stored(_similar_groups(docs, prints, shingle, similarity), "groups")
    stays = groups.groupBy("group").agg(F.min("rep").alias("stays"))
    mine = prints.where("print is not null").select("doc_id", "key", "same").distinct().join(groups.join(stays, "group").select("same", "stays"), "same")
    gone = mine.where(~(F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("key") == F.col("stays.key")))).select("doc_id", "key")
    return without_rows(docs, gone, digest(F.col("text")))
