"""Benchmark decontamination by latent semantic retrieval.

1. *Counts.*  Texts become ids of the benchmark's words, kept in the shared folder, and are cut
   into passages of 60 words; one pass counts, for each word of the benchmark, the passages
   that have it.
2. *Randomised SVD.*  A second pass sums A' (A O), A being the TF-IDF passages over those words
   and O a sparse random sign matrix: a part in each task, added up in two levels.  The
   SVD of the sum gives the latent basis and scale.
3. *Candidates.*  Every window of three blocks of 20 words (two blocks for short items) is
   projected, and compared by cosine with every item of a benchmark block; none is capped.
   Beside it, pieces that stand in a text word by word are looked up at their rarest word, whatever
   their cosine; for items of fewer than ``least`` words this is the only search.
4. *Checks.*  A bound that loses nothing (words of the window that the item has, and rare ones
   among them) goes first.  The longest common subsequence of words covers enough of the item, and of its
   answer (the words of its last sentence, its last quarter at least).

The benchmark is taken in blocks of at most ``block`` items, the stated query set, each
checked against all rows.  Items longer than 40 words are searched in pieces; a piece that is
found flags the document.

Defined cases: null and empty texts match nothing; items without words, and null items,
are skipped; an item of fewer than ``least`` words must occur word by word; repeated ids are
rows of their own; an empty table or benchmark flags nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import parts, stored
from .repeats import arrow_schema

BLOCK, WIDE, PIECE = 20, 3, 40
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
OUT = "doc_id long, item_id long, similarity double, overlap double, answer_overlap double, word_start long"
SUMS = "slot long, part binary"
IDS = "doc_id long, ids binary"
BATCH = 100_000  # words worked on at a time


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; ids of 0 match nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x, 0) if x else 0
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Items:
    """Pieces of a block of items, over a vocabulary of ids from 1."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.pieces: list[tuple[int, list[int], list[int]]] = []
        for item, text in items:
            w = words_of(text)
            if not w:
                continue
            ids = [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w]
            tail = len(words_of(re.split(r"[.?!]\s+", text.strip())[-1]))
            for at in range(0, len(ids), PIECE):
                part = ids[at : at + PIECE]
                if at and len(part) < 15:
                    part = ids[len(ids) - 15 :]
                n = min(len(part), max(tail if at + PIECE >= len(ids) else 0, -(-len(part) // 4)))
                self.pieces.append((item, part, part[-n:]))
        self.size = len(self.vocabulary) + 1

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int32)


def blocks(seqs):
    """(ids in rows of BLOCK, padded with -1; first block of each text, and their number) of so many texts at a time."""
    held, first, done, size, n = [], [0], 0, 0, len(seqs)
    for i, ids in enumerate(seqs):
        pad = -len(ids) % BLOCK
        held.append(ids)
        if pad:
            held.append(np.full(pad, -1, np.int32))
        size += len(ids) + pad
        first.append(size // BLOCK)
        if size >= BATCH or i == n - 1:
            yield done, np.concatenate(held).reshape(-1, BLOCK), np.array(first)
            held, first, done, size = [], [0], i + 1, 0


def ids_of(b: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()]


def _passages(first: np.ndarray, n: int) -> np.ndarray:
    """Number of the passage (WIDE blocks, counted within each text) of each block."""
    inside = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    new = inside % WIDE == 0
    return np.cumsum(new) - 1


def _added(df: DataFrame, dtype) -> dict[int, np.ndarray]:
    """Sums of the arrays of each slot, in two levels."""

    def add(key, table):
        total = None
        for x in table.column("part").to_pylist():
            y = np.frombuffer(x, dtype)
            total = y if total is None else total + y
        return pa.table([[key[0].as_py()], [total.tobytes()]], schema=arrow_schema(SUMS))

    once = df.groupBy("slot", F.pmod(F.xxhash64("part"), F.lit(64)).alias("salt")).applyInArrow(lambda k, t: add(k, t.select(["part"])), SUMS)
    return {r["slot"]: np.frombuffer(r["part"], dtype) for r in once.groupBy("slot").applyInArrow(add, SUMS).collect()}  # a row for each slot of the vocabulary


class Latent:
    def __init__(self, items: Items, dims: int = 128, common: float = 0.03, seed: int = 11):
        self.items, self.dims, self.common = items, dims, common
        rng = np.random.default_rng(seed)
        self.bucket, self.sign = rng.integers(0, dims, items.size), rng.choice([-1.0, 1.0], items.size)
        self.idf, self.basis = np.zeros(items.size), np.zeros((items.size, dims))
        self.rarity = np.zeros(items.size)

    def count(self, docs: DataFrame) -> None:
        size = self.items.size

        def run(batches):
            df = np.zeros(size + 1, np.int64)
            for b in batches:
                for _, ids, first in blocks(ids_of(b)):
                    if not len(ids):
                        continue
                    p = np.repeat(_passages(first, len(ids)), BLOCK)
                    flat = ids.ravel()
                    ok = flat > 0
                    k = np.sort(p[ok] * size + flat[ok].astype(np.int64))
                    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
                    df[:size] += np.bincount(k % size, minlength=size)
                    df[size] += int(p[-1]) + 1
            yield pa.record_batch([pa.array([0], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["slot", "part"])

        df = _added(docs.mapInArrow(run, SUMS), np.int64).get(0, np.zeros(size + 1, np.int64))
        n = max(1, int(df[-1]))
        full = np.maximum(np.log((n + 1) / (df[:-1] + 1.0)), 0.1)
        self.rarity = full
        idf = np.where(df[:-1] > self.common * n, 0, full)
        for _, piece, _ in self.items.pieces:  # a piece of common words keeps the rarest half of them
            left = -(-len(piece) // 2) - int(np.count_nonzero(idf[piece]))
            if left > 0:
                zero = sorted({w for w in piece if not idf[w]}, key=lambda w: (-full[w], w))[:left]
                idf[zero] = full[zero]
        idf[0] = np.log(n + 1.0)  # words the benchmark does not have
        self.idf = idf

    def fit(self, docs: DataFrame) -> None:
        size, dims, bucket, sign = self.items.size, self.dims, self.bucket, self.sign
        idf = self.idf.copy()
        idf[0] = 0

        def run(batches):
            y = np.zeros((size, dims))
            for b in batches:
                for _, ids, first in blocks(ids_of(b)):
                    if not len(ids):
                        continue
                    p = np.repeat(_passages(first, len(ids)), BLOCK)
                    flat = ids.ravel()
                    ok = (flat > 0) & (idf[flat] > 0)
                    w, p = flat[ok].astype(np.int64), p[ok]
                    if not len(w):
                        continue
                    ao = np.bincount(p * dims + bucket[w], weights=idf[w] * sign[w], minlength=(int(p[-1]) + 1) * dims).reshape(-1, dims).astype(np.float32)
                    order = np.argsort(w, kind="stable")
                    head = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
                    y[w[order][head]] += np.add.reduceat(ao[p[order]], head, axis=0)
            y *= idf[:, None]
            slots = range(0, size, 4096)
            yield pa.record_batch([pa.array(list(slots), pa.int64()), pa.array([y[s : s + 4096].astype(np.float32).tobytes() for s in slots], pa.binary())], names=["slot", "part"])

        y = np.zeros((size, dims))
        for s, x in _added(docs.mapInArrow(run, SUMS), np.float32).items():
            y[s : s + 4096] = x.reshape(-1, dims)
        u, sv, _ = np.linalg.svd(y, full_matrices=False)
        scale = np.sqrt(np.maximum(sv, 1e-9))
        self.basis[:, : u.shape[1]] = np.where(sv > 1e-9 * max(sv.max(), 1e-30), u / scale * scale.max(), 0)

    def ready(self, cosine: float, overlap: float, answer: float, least: int) -> None:
        self.cosine, self.overlap, self.answer, self.least = cosine, overlap, answer, least
        weighted = self.basis * self.idf[:, None]
        weighted[0] = 0
        self.weighted = np.vstack([weighted, np.zeros(self.dims)]).astype(np.float32)  # -1 is the last row
        q = np.array([self.weighted[p].sum(0) for _, p, _ in self.items.pieces]).reshape(-1, self.dims)
        self.query = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        n = np.array([len(p) for _, p, _ in self.items.pieces])
        self.length = n
        self.short, self.wide = np.flatnonzero((n < BLOCK) & (n >= least)), np.flatnonzero((n >= BLOCK) & (n >= least))
        self.whole = np.full((len(n), PIECE), -2, np.int32)
        anchor, self.before = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)  # a piece's rarest word, and the words before it
        for k, (_, p, _) in enumerate(self.items.pieces):
            self.whole[k, : len(p)] = p
            self.before[k] = int(np.argmax(self.rarity[p]))
            anchor[k] = p[self.before[k]]
        self.by_anchor = np.argsort(anchor, kind="stable")
        self.anchored = np.append(np.bincount(anchor, minlength=self.items.size), 0)  # -1 is the last
        self.anchor_head = np.cumsum(self.anchored) - self.anchored
        self.member = np.zeros((len(n), self.items.size + 1), np.int8)  # 1: a word of the piece; 2 more if it is rare
        rare = self.idf > 0
        self.common_words = np.zeros(len(n), np.int64)
        for k, (_, p, _) in enumerate(self.items.pieces):
            self.member[k, p] = 1 + 2 * rare[p]
            self.common_words[k] = int((~rare[p]).sum())

    def matches(self, seqs: list[np.ndarray]) -> list[tuple]:
        """(row, item, cosine, overlap, answer overlap, first word of the window), the best of each row and item."""
        best: dict[tuple[int, int], tuple] = {}
        for row0, ids, first in blocks(seqs):
            if not len(ids):
                continue
            z = np.zeros((len(ids) + 1, self.dims))
            for at in range(0, len(ids), 1000):
                z[at + 1 : at + 1001] = self.weighted[ids[at : at + 1000]].sum(1)
            np.cumsum(z, axis=0, out=z)
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            stop = first[text + 1]
            self._verbatim(ids, z, row0, text, first, stop, best)
            for group, width in ((self.wide, WIDE), (self.short, 2)):
                if not len(group):
                    continue
                end = np.minimum(np.arange(len(ids)) + width, stop)
                win = (z[end] - z[:-1]).astype(np.float32)
                win /= np.maximum(np.linalg.norm(win, axis=1, keepdims=True), 1e-6)
                for w0 in range(0, len(win), 2048):
                    cos = win[w0 : w0 + 2048] @ self.query[group].T
                    a, b = np.nonzero(cos >= (self.cosine if width == WIDE else self.cosine * 0.7))  # short items fill less of a window
                    near, a, k = cos[a, b], a + w0, group[b]
                    for c0 in range(0, len(a), 20_000):
                        self._check(ids, a[c0 : c0 + 20_000], end, k[c0 : c0 + 20_000], near[c0 : c0 + 20_000], width, row0, text, first, best)
        return [(r, item, c, s, a, -w) for (r, item), (s, c, a, w) in sorted(best.items())]

    def _verbatim(self, ids, z, row0, text, first, stop, best) -> None:
        """Adds the pieces that stand in a text word by word."""
        flat = ids.ravel()
        at = np.flatnonzero(self.anchored[flat])
        for c0 in range(0, len(at), 20_000):
            pos = at[c0 : c0 + 20_000]
            c = self.anchored[flat[pos]]
            k = self.by_anchor[np.arange(int(c.sum())) + np.repeat(self.anchor_head[flat[pos]] - (np.cumsum(c) - c), c)]
            start = np.repeat(pos, c) - self.before[k]
            end = start + self.length[k]
            ok = (start >= 0) & (end <= len(flat))
            ok[ok] = text[start[ok] // BLOCK] == text[(end[ok] - 1) // BLOCK]
            start, k = start[ok], k[ok]
            for j in range(PIECE):
                if not len(k):
                    break
                ok = (self.length[k] <= j) | (flat[np.minimum(start + j, len(flat) - 1)] == self.whole[k, j])
                start, k = start[ok], k[ok]
            for x, y in zip(start.tolist(), k.tolist(), strict=True):
                i = x // BLOCK
                win = z[min(i + (WIDE if self.length[y] >= BLOCK else 2), int(stop[i]))] - z[i]
                near = float(win @ self.query[y]) / max(float(np.linalg.norm(win)), 1e-6)
                key, got = (row0 + int(text[i]), self.items.pieces[y][0]), (1.0, near, 1.0, -(i - int(first[text[i]])) * BLOCK)
                if key not in best or got > best[key]:
                    best[key] = got

    def _check(self, ids, a, end, k, near, width, row0, text, first, best) -> None:
        at = a[:, None] + np.arange(width)
        words = ids[np.minimum(at, len(ids) - 1)]
        words = np.where((at < end[a][:, None])[:, :, None], words, -1).reshape(len(a), -1)
        has = self.member[k[:, None], words]  # -1 is the last column, which is 0
        need = np.ceil(self.overlap * self.length[k] - 1e-9)
        ok = np.count_nonzero(has, axis=1) >= need
        ok &= np.count_nonzero(has == 3, axis=1) >= need - self.common_words[k]
        for j in np.flatnonzero(ok).tolist():
            i = int(a[j])
            item, piece, answer = self.items.pieces[k[j]]
            seq = np.maximum(words[j], 0).tolist()
            share = lcs(piece, seq) / len(piece)
            if share < self.overlap:
                continue
            ans = lcs(answer, seq) / len(answer)
            if ans < self.answer:
                continue
            key = (row0 + int(text[i]), item)
            got = (share, float(near[j]), ans, -(i - int(first[text[i]])) * BLOCK)
            if key not in best or got > best[key]:
                best[key] = got


def retrievers(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.35, overlap: float = 0.6, answer: float = 0.5, least: int = 8, block: int = 1000) -> list[tuple[Latent, DataFrame]]:
    """A fitted retriever for each block of items, and the ids of the texts' words.  Statistics are of all rows of docs."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    n, out = items.count(), []
    blocks_of_items = max(1, -(-n // block))
    for k in range(blocks_of_items):
        part = Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks_of_items)) == k).collect()])
        if not part.pieces:
            continue

        def run(batches, part=part):
            for b in batches:
                yield pa.record_batch([b.column("doc_id"), pa.array([part.encode(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "ids"])

        ids = stored(parts(docs).mapInArrow(run, IDS), "ids")
        model = Latent(part)
        model.count(ids)
        model.fit(ids)
        model.ready(cosine, overlap, answer, least)
        out.append((model, ids))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document and item found in it; documents without any have none."""
    out = docs.sparkSession.createDataFrame([], OUT)
    for model, ids in retrievers(docs, benchmark, **options):

        def run(batches, model=model):
            for b in batches:
                found = model.matches(ids_of(b))
                own = b.column("doc_id").to_pylist()
                cols = list(zip(*((own[r], *rest) for r, *rest in found), strict=True)) or [()] * 6
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(cols, arrow_schema(OUT), strict=True)], schema=arrow_schema(OUT))

        out = out.unionByName(ids.mapInArrow(run, OUT))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, in whose text no item is found."""
    out = docs
    for model, _ in retrievers(docs, benchmark, **options):

        def run(batches, model=model):
            for b in batches:
                hit = {m[0] for m in model.matches([model.items.encode(t) for t in b.column(text).to_pylist()])}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
