"""Exact search for windows of symbols that repeat across documents.

Used by the two substring operators.  A document is a sequence of symbols (bytes or
words); a ``Method`` says how windows are named and how an owner puts them in order.  Steps, each bounded in
memory:

1. *Rounds of names.*  In each of the method's rounds a batch of documents sends the distinct
   names that it proposes, 8 bytes each before packing, with a bit that tells whether two of its documents have
   the name.  Equal windows propose equal names in every document.  The task that owns a name's slot marks
   the names met in two batches, or twice in one, and sends one bit a name back; the next round names what
   stands between shared names alone.
2. *Segments.*  Each stretch of windows about one shared name is sent, as the symbols
   themselves, to the owner of the name; equal stretches of one batch are sent once, with the
   least and the greatest doc_id.
3. *Owners.*  Equal stretches of several batches are merged.  The owner puts the windows of its slot in
   order, by the symbols themselves, so that equal ones stand together, and finds for each class the least doc_id.
4. *Cover.*  Each batch gets the runs of windows with an earlier owner, and marks the
   symbols they cover.

Rows that cross the network are packed arrays, a row for each (batch, slot).  A text or
passage that a third of all documents hold comes once from each batch, so no task meets
more of it than there are batches.  Nothing is dropped, capped or sampled.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import text_bytes

NONE = np.iinfo(np.int64).max  # stands for a null doc_id: later than all others
CHUNK = 1 << 19
PACKED = "slot long, batch long, kind int, a binary, b binary, c binary, d binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
S1, S2 = np.uint64(31), np.uint64(29)
DATA, OWN, ECHO = 0, 1, 2  # kinds of rows; the last two pass through a slot of their batch's own


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(",")])


def pair_names(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit name for each pair of names."""
    r = x * M1
    r ^= r >> S1
    r += y * M2
    r ^= r >> S2
    r *= M1
    return r


def names(sym: np.ndarray, length: int) -> np.ndarray:
    """Names of all runs of ``length`` symbols, by rounds that name pairs of runs."""
    if sym.dtype == np.uint8:
        table = pair_names(np.arange(256, dtype=np.uint64) + M2, np.full(256, M1))
        level = table[sym]
    else:
        level = sym.copy()
    size, out, done = 1, None, 0
    n = len(sym)
    while True:
        if length & size:  # the run is cut into powers of two, short ones first
            if out is None:
                out = level[: n - length + 1 + 0] if size == length else level
                done = size
            else:
                m = n - (done + size) + 1
                out = pair_names(out[:m], level[done : done + m])
                done += size
        if done == length:
            return out[: n - length + 1]
        m = n - 2 * size + 1
        level = pair_names(level[:m], level[size : size + m])
        size *= 2


def member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are among a sorted array."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after another."""
    return np.arange(int(size.sum())) + np.repeat(start - starts_of(size), size)


class Method:
    """How windows of ``window`` symbols are named and put in order.

    prepare(texts): an object with ``bounds``, the first symbol of each text and their number.
    propose(own, shared): names and their symbols' places in the round after those whose shared names (sorted) are
    given.  segments(own, shared): start, number of windows and name of each stretch to send.  cut(own, at, size):
    the symbols there, as bytes; joined and parted put such pieces together and take them apart.
    load(pieces): symbols of all pieces.  order(symbols, at): the windows at ``at`` in an order in which equal ones
    stand together, and whether each differs from the one before it.
    """

    window: int
    rounds: int

    def joined(self, pieces: list[bytes]) -> bytes:
        return b"".join(pieces)

    def parted(self, blob: bytes, sizes: np.ndarray) -> list[bytes]:
        return [blob[a : a + n] for a, n in zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True)]


def segments(sym: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and anchor name of each stretch of windows with one anchor: the window's run of
    ``gram`` symbols of least name.

    bounds: starts of the documents in sym, and its length.
    """
    n = len(sym)
    out: tuple[list, list, list] = ([], [], [])
    low = np.uint64(2 * CHUNK - 1)
    for at in range(0, max(0, n - window + 1), CHUNK):
        part = sym[at : at + CHUNK + window - 1]
        g = names(part, gram)
        key = g & ~low
        key |= np.arange(len(g), dtype=np.uint64)
        width, have = window - gram + 1, 1
        while 2 * have <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        pos = (key & low).astype(np.int64)
        ok = np.ones(len(pos), bool)
        inner = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, at + len(part), "left")] - at
        if len(inner):
            if len(inner) * window > 4 * len(ok):
                bad = np.zeros(len(ok) + 1, np.int32)
                np.add.at(bad, np.clip(inner - window + 1, 0, len(ok)), 1)
                np.add.at(bad, np.clip(inner, 0, len(ok)), -1)
                ok = np.cumsum(bad[:-1]) == 0
            else:
                for b in inner.tolist():
                    ok[max(0, b - window + 1) : b] = False
        first = np.empty(len(pos), bool)
        first[:1] = True
        np.not_equal(pos[1:], pos[:-1], out=first[1:])
        first[1:] |= ok[1:] != ok[:-1]
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(pos)))
        keep = ok[starts]
        starts, lengths = starts[keep], lengths[keep]
        out[0].append(starts + at)
        out[1].append(lengths)
        out[2].append(g[pos[starts]])
    if not out[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in out)


def squeezed(x: np.ndarray | bytes) -> bytes:
    """Compressed bytes; of numbers, all first bytes come first, then all second ones, and so on."""
    if not isinstance(x, bytes):
        x = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.Codec("zstd").compress(x, asbytes=True)


def opened(x: bytes, dtype=None) -> np.ndarray | bytes:
    got = pa.Codec("zstd").decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True)
    if dtype is None:
        return got
    return np.ascontiguousarray(np.frombuffer(got, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).reshape(-1).view(dtype)


def bundles(batches):
    """Documents of one batch in one row: ids and texts, compressed."""
    for b in batches:
        key = b.column("batch").to_numpy(zero_copy_only=False)
        ids, texts = b.column("doc_id").to_pylist(), b.column("text")
        order = np.argsort(key, kind="stable")
        rows = []
        for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []:
            held = [(ids[i], (texts[i].as_py() or "").encode()) for i in part.tolist()]
            rows.append((int(key[part[0]]), squeezed(pickle.dumps(held, 5))))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["batch", "bundle"])


def batch_of(table: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    """Ids, texts and ids as numbers of a batch, in an order that the rows alone determine."""
    held = [x for r in table.column("bundle").to_pylist() for x in pickle.loads(opened(r))]
    ids, texts = [x[0] for x in held], [x[1] for x in held]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], np.array([NONE if ids[i] is None else ids[i] for i in order], np.int64)


def _packed(rows: list[tuple]) -> pa.Table:
    schema = arrow_schema(PACKED)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.table([pa.array(list(c), t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)


def windows_seen_before(docs: DataFrame, method: Method, finish: Callable, out_ddl: str, batch_bytes: int = 4 << 20, slot_bytes: int = 4 << 20) -> DataFrame:
    """For each document, finish(ids, texts, bounds, cover): cover marks the symbols to remove.

    docs: doc_id, text.  A window counts as seen if it starts in a document of smaller doc_id too.
    """
    window, total = method.window, text_bytes(docs)
    batches, slots = max(4, -(-total // batch_bytes)), max(4, -(-total // slot_bytes))
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(batches))).mapInArrow(bundles, "batch long, bundle binary")

    def by_slot(h: np.ndarray):
        s = ((h >> np.uint64(8)) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(s, kind="stable")
        cut = np.flatnonzero(np.diff(s[order])) + 1
        for part in np.split(order, cut) if len(order) else []:
            yield int(s[part[0]]), part

    def proposals(own, num, shared):
        """Distinct names of a round, sorted, and whether two documents have each."""
        g, at = method.propose(own, shared)
        if not len(g):
            return g, np.zeros(0, bool)
        doc = num[np.searchsorted(own.bounds, at, "right") - 1]
        order = np.argsort(g, kind="stable")
        g, doc = g[order], doc[order]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        return g[head], np.minimum.reduceat(doc, head) != np.maximum.reduceat(doc, head)

    def shared_names(own, num, marks):
        """Names of each round that are shared, by the bits that came back: of each round, of each slot."""
        out = []
        for bits in marks:
            g, _ = proposals(own, num, out)
            on = np.zeros(len(g), bool)
            for s, part in by_slot(g):
                if s in bits:
                    on[part] = np.unpackbits(np.frombuffer(opened(bits[s]), np.uint8), count=len(part)).astype(bool)
            out.append(g[on])
        return out

    def marks_of(table) -> list[dict[int, bytes]]:
        """Bits of all rounds so far: earlier ones from the batch's echo, the last from the owners."""
        rows = table.to_pylist()
        out = next((pickle.loads(r["a"]) for r in rows if r["kind"] == ECHO), [])
        return [*out, {r["slot"]: r["a"] for r in rows if r["kind"] == DATA}]

    def find(key, table, *came):
        if not table.num_rows or (came and not came[0].num_rows):
            return _packed([])
        batch, marks = key[0].as_py(), marks_of(came[0]) if came else []
        _, texts, num = batch_of(table)
        own = method.prepare(texts)
        g, twice = proposals(own, num, shared_names(own, num, marks))
        rows = [(s, batch, DATA, squeezed(np.diff(g[i], prepend=np.uint64(0))), squeezed(np.packbits(twice[i]).tobytes()), None, None) for s, i in by_slot(g)]
        if marks and rows:
            rows.append((slots + batch, batch, ECHO, pickle.dumps(marks), None, None, None))
        return _packed(rows)

    def share(key, table):
        if key[0].as_py() >= slots:
            return table
        came = [np.cumsum(opened(x, np.uint64), dtype=np.uint64) for x in table.column("a").to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(opened(x), np.uint8), count=len(k)) for x, k in zip(table.column("b").to_pylist(), came, strict=True)]).astype(bool)
        h = np.concatenate(came)
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        head = np.flatnonzero(new)
        often = (np.diff(np.append(head, len(h))) > 1) | np.logical_or.reduceat(twice[order], head)
        flag = np.empty(len(h), bool)
        flag[order] = often[np.cumsum(new) - 1]
        rows, at = [], 0
        for b, x in zip(table.column("batch").to_pylist(), came, strict=True):
            on = flag[at : at + len(x)]
            at += len(x)
            if on.any():
                rows.append((key[0].as_py(), b, DATA, squeezed(np.packbits(on).tobytes()), None, None, None))
        return _packed(rows)

    def send(key, table, came):
        if not table.num_rows or not came.num_rows:
            return _packed([])
        batch = key[0].as_py()
        _, texts, num = batch_of(table)
        own = method.prepare(texts)
        p0, count, g = method.segments(own, shared_names(own, num, marks_of(came)))
        row = np.searchsorted(own.bounds, p0, "right") - 1
        doc = num[row].tolist()
        known: dict[bytes, int] = {}
        which, least, most, first = np.empty(len(p0), np.int64), [], [], []
        for i, (p, c, d) in enumerate(zip(p0.tolist(), count.tolist(), doc, strict=True)):
            k = known.setdefault(method.cut(own, p, c + window - 1), len(known))
            which[i] = k
            if k == len(least):
                least.append(d)
                most.append(d)
                first.append(i)
            elif d < least[k]:
                least[k] = d
            elif d > most[k]:
                most[k] = d
        if not first:
            return _packed([])
        contents = list(known)
        least, most, head = np.array(least), np.array(most), np.array(first)
        slot, index = np.empty(len(head), np.int64), np.empty(len(head), np.int64)
        rows = []
        for s, part in by_slot(g[head]):
            slot[part], index[part] = s, np.arange(len(part))
            rows.append((s, batch, DATA, squeezed(method.joined([contents[k] for k in part.tolist()])), squeezed(count[head[part]].astype(np.uint32)), squeezed(least[part]), squeezed(most[part] - least[part])))
        place = (slot << 32 | index)[which]
        rows.append((slots + batch, batch, OWN, squeezed(place), squeezed(np.diff(p0, prepend=0)), squeezed(row.astype(np.int64)), None))
        return _packed(rows)

    def resolve(key, table):
        if key[0].as_py() >= slots:
            return table
        slot = key[0].as_py()
        a, b, c, d = (table.column(n).to_pylist() for n in "abcd")
        counts = [opened(x, np.uint32).astype(np.int64) for x in b]
        count = np.concatenate(counts)
        least = np.concatenate([opened(x, np.int64) for x in c])
        most = least + np.concatenate([opened(x, np.int64) for x in d])
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(p, len(known)) for x, n in zip(a, counts, strict=True) for p in method.parted(opened(x), n + window - 1)), np.int64, len(count))
        del a, b, c, d
        least_of, own = np.full(len(known), NONE), np.empty(len(known), np.int64)  # of each distinct stretch
        np.minimum.at(least_of, which, least)
        own[which] = count
        sym = method.load(list(known))
        del known
        at = spread(starts_of(own + window - 1), own)
        order, new = method.order(sym, at)
        del sym, at
        stretch = np.repeat(np.arange(len(own)), own)
        head = np.flatnonzero(new)
        before = np.empty(len(order), np.int64)
        before[order] = np.repeat(np.minimum.reduceat(least_of[stretch[order]], head), np.diff(np.append(head, len(order))))
        turn = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (stretch[1:] != stretch[:-1])])
        length, begin = np.diff(np.append(turn, len(before))), starts_of(own)
        low = np.searchsorted(stretch[turn], np.arange(len(own) + 1))
        rows, s0 = [], 0
        for batch, n in zip(table.column("batch").to_pylist(), map(len, counts), strict=True):
            u = which[s0 : s0 + n]
            many = (low[1:] - low[:-1])[u]
            t, seg = spread(low[u], many), np.repeat(np.arange(n), many)
            ok = before[turn[t]] < most[s0 + seg]
            t, seg = t[ok], seg[ok]
            if len(t):
                rows.append((slot, batch, DATA, squeezed((slot << 32 | seg).astype(np.int64)), squeezed((turn[t] - begin[u[seg]]).astype(np.int64)), squeezed(length[t].astype(np.int64)), squeezed(before[turn[t]])))
            s0 += n
        return _packed(rows)

    def cover(_, table, found):
        ids, texts, num = batch_of(table)
        own = method.prepare(texts)
        bounds = own.bounds
        diff = np.zeros(int(bounds[-1]) + 1, np.int32)
        kind = found.column("kind").to_pylist() if found.num_rows else []
        if DATA in kind and OWN in kind:
            rows = found.to_pylist()
            mine = next(r for r in rows if r["kind"] == OWN)
            place, p0, row = (opened(mine[k], np.int64) for k in "abc")
            p0 = np.cumsum(p0)
            key, skip, run, before = (np.concatenate([opened(r[k], np.int64) for r in rows if r["kind"] == DATA]) for k in "abcd")
            order = np.argsort(key, kind="stable")
            key, skip, run, before = key[order], skip[order], run[order], before[order]
            lo, hi = np.searchsorted(key, place, "left"), np.searchsorted(key, place, "right")
            times = hi - lo
            occ, r = np.repeat(np.arange(len(place)), times), spread(lo, times)
            on = before[r] < num[row[occ]]
            begin = (p0[occ] + skip[r])[on]
            np.add.at(diff, begin, 1)
            np.add.at(diff, begin + run[r][on] + window - 1, -1)
        return finish(ids, texts, bounds, np.cumsum(diff[:-1]) > 0)

    groups = dealt.groupBy("batch")
    marks = groups.applyInArrow(lambda key, table: find(key, table), PACKED).groupBy("slot").applyInArrow(share, PACKED)
    for _ in range(method.rounds - 1):
        marks = groups.cogroup(marks.groupBy("batch")).applyInArrow(lambda key, table, came: find(key, table, came), PACKED).groupBy("slot").applyInArrow(share, PACKED)
    sent = groups.cogroup(marks.groupBy("batch")).applyInArrow(send, PACKED)
    found = sent.groupBy("slot").applyInArrow(resolve, PACKED)
    return groups.cogroup(found.groupBy("batch")).applyInArrow(cover, out_ddl)
