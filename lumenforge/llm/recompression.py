"""Recompression of symbol sequences: locally consistent names of runs and pairs, in rounds over the whole corpus.

A round names each maximal run of one symbol, then each adjacent pair whose left symbol is of
class 0 and whose right one is of class 1; the class is a bit of the symbol's name.  All else is
carried on.  What a round makes of a symbol hangs on its neighbours alone, so equal substrings get
equal interior symbols wherever they stand.  The names of a round are gathered over all documents before the next
begins: a name that one document alone has joins nothing any more, and a window that holds it is no repeat.
A name is a 64-bit hash of what it stands for, alike in every task (words are compared as words in the end); what comes back from a round is whether it is shared.

With each symbol goes the stretch of tokens that settles it: its own, and those of the
neighbours that decided how it was made.  A symbol whose stretch lies inside a window is an interior symbol of it,
found in every copy of the window.  A window all of whose interior symbols are shared may repeat; of those of the highest
round the one of least name brings its copies together.  A window without any (about 1 of 170, and those
inside long runs) is brought together by its own name.
"""

from __future__ import annotations

import numpy as np

from .repeats import CHUNK, Method, member, names, pair_names

FAR = np.int64(1) << 40
MIX = np.uint64(0xD6E8FEB86659FD93)
RUN, ANCHOR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
TOP = np.uint64(1 << 63)


class Level:
    """Symbols in order: name, document, the stretch [lo, hi) that settles each, and whether a round named it."""

    __slots__ = ("name", "doc", "lo", "hi", "made")

    def __init__(self, name, doc, lo, hi, made):
        self.name, self.doc, self.lo, self.hi, self.made = name, doc, lo, hi, made

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the stretch of the neighbour before begins and that of the one after ends; far off at a document's edge."""
        before, after = np.full(len(self.lo), -FAR), np.full(len(self.hi), FAR)
        same = self.doc[1:] == self.doc[:-1]
        before[1:] = np.where(same, self.lo[:-1], -FAR)
        after[:-1] = np.where(same, self.hi[1:], FAR)
        return before, after


def runs(s: Level) -> tuple[Level, np.ndarray]:
    """Maximal runs as one symbol each, and which are new names."""
    n = len(s.name)
    head = np.empty(n, bool)
    head[:1] = True
    head[1:] = (s.name[1:] != s.name[:-1]) | (s.doc[1:] != s.doc[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], n) - 1
    length = last - first + 1
    before, after = s.beside()
    new = length > 1
    name = np.where(new, pair_names(s.name[first], length.astype(np.uint64) * RUN), s.name[first])
    lo, hi = (np.minimum.reduceat(s.lo, first), np.maximum.reduceat(s.hi, first)) if n else (s.lo, s.hi)
    return Level(name, s.doc[first], np.minimum(lo, before[first]), np.maximum(hi, after[last]), s.made[first] | new), new


def pairs(s: Level, turn: int, joinable: np.ndarray) -> tuple[Level, np.ndarray]:
    """Pairs of joinable symbols of class 0 and class 1 as one symbol each, and which are new names."""
    side = ((s.name * MIX) >> np.uint64(40 + turn)) & np.uint64(1)
    n = len(side)
    joins = np.zeros(n, bool)  # with the symbol after it
    joins[:-1] = (side[:-1] == 0) & (side[1:] == 1) & (s.doc[1:] == s.doc[:-1]) & joinable[:-1] & joinable[1:]
    gone = np.zeros(n, bool)
    gone[1:] = joins[:-1]
    left = np.flatnonzero(~gone)
    new = joins[left]
    mate = np.minimum(left + 1, n - 1)
    before, after = s.beside()
    # a symbol left alone hangs on the neighbour that it might have joined
    lo = np.where(new | (side[left] == 0), s.lo[left], np.minimum(s.lo[left], before[left]))
    hi = np.where(new, np.maximum(s.hi[left], s.hi[mate]), np.where(side[left] == 0, np.maximum(s.hi[left], after[left]), s.hi[left]))
    lo = np.where(new, np.minimum(lo, s.lo[mate]), lo)
    name = np.where(new, pair_names(s.name[left], s.name[mate] ^ np.uint64(turn)), s.name[left])
    return Level(name, s.doc[left], lo, hi, s.made[left] | new), new


def one_round(s: Level, turn: int, shared: np.ndarray | None) -> tuple[Level, list[tuple]]:
    """The next level, and lo, hi and name of its new symbols.  shared: the shared names of the round before."""
    s, new = runs(s)
    found = [(s.lo[new], s.hi[new], s.name[new])]
    s, new = pairs(s, turn, np.ones(len(s.name), bool) if shared is None else ~s.made | member(s.name, shared))
    found.append((s.lo[new], s.hi[new], s.name[new]))
    return s, found


class View:
    """Windows and interior symbols of a piece of the text, up to the round after ``shared``'s or to ``rounds``.

    whole: windows within one document.  alive: whole windows without an interior symbol that is known not to be shared.  bare:
    windows without an interior symbol.
    """

    def __init__(self, sym: np.ndarray, doc: np.ndarray, window: int, shared: list[np.ndarray], rounds: int):
        self.window, self.m = window, len(sym) - window + 1
        at = np.arange(len(sym), dtype=np.int64)
        s, self.found = Level(sym, doc, at, at + 1, np.zeros(len(sym), bool)), []
        self.whole = doc[: self.m] == doc[window - 1 :]
        dead, covered = np.zeros(self.m + 1, np.int64), np.zeros(self.m + 1, np.int64)
        for r in range(rounds):
            s, got = one_round(s, r, shared[r - 1] if r else None)
            lo, hi, name = (np.concatenate(x) for x in zip(*got, strict=True))
            fits = hi - lo <= window
            order = np.lexsort((hi[fits], lo[fits]))
            lo, hi, name = (x[fits][order] for x in (lo, hi, name))
            a, b = np.maximum(hi - window, 0), np.minimum(lo, self.m - 1)  # the first and last window that hold it
            ok = a <= b
            a, b, lo, name = a[ok], b[ok], lo[ok], name[ok]
            self._mark(covered, a, b)
            if r < len(shared):
                off = ~member(name, shared[r])
                self._mark(dead, a[off], b[off])
            self.found.append((a, b, lo, name))
        self.alive = self.whole & (np.cumsum(dead[:-1]) == 0)
        self.bare = np.cumsum(covered[:-1]) == 0

    def _mark(self, diff: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        diff += np.bincount(a, minlength=self.m + 1) - np.bincount(b + 1, minlength=self.m + 1)

    def useful(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and places of the last round's symbols that a live window holds."""
        a, b, lo, name = self.found[-1]
        live = np.concatenate([[0], np.cumsum(self.alive)])
        on = live[b + 1] > live[a]
        return name[on], lo[on]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window the symbol (a number, -1 for none) that brings its copies together, and the symbols' names."""
        names_of = np.concatenate([f[3] for f in self.found])
        low = np.uint64((1 << max(1, len(names_of).bit_length())) - 1)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        steps = [np.full(self.m, none) for _ in range(self.window.bit_length())]
        base = 0
        for r, (a, b, _, name) in enumerate(self.found):
            value = (pair_names(name, np.full(len(name), ANCHOR)) >> np.uint64(1)) & ~low | np.arange(base, base + len(name), dtype=np.uint64)
            if r < len(self.found) - 1:
                value |= TOP  # the highest round first
            base += len(name)
            k = np.log2(b - a + 1).astype(np.int64)
            for i in range(len(steps)):
                on = np.flatnonzero(k == i)
                np.minimum.at(steps[i], a[on], value[on])
                np.minimum.at(steps[i], b[on] - (1 << i) + 1, value[on])
        for i in range(len(steps) - 1, 0, -1):  # a least value of 2^i windows is one of both halves
            half = 1 << (i - 1)
            steps[i - 1] = np.minimum(steps[i - 1], steps[i])
            if half < self.m:
                steps[i - 1][half:] = np.minimum(steps[i - 1][half:], steps[i][:-half])
        return np.where(steps[0] == none, -1, (steps[0] & low).astype(np.int64)), names_of


SPACES = bytes(32 if c in b"\t\n\v\f\r" else c for c in range(256))
LETTERS = pair_names(np.arange(256, dtype=np.uint64) + ANCHOR, np.full(256, RUN))
BACK = np.uint64(pow(int(MIX), -1, 1 << 64))
SLICE = 1 << 17  # words named at a time
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MIX and of its inverse, n of each at least."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, MIX), np.full(size, BACK)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


class Words:
    """Words of a batch: where they are in the text, and their names, sums of letters times powers scaled to the word's start."""

    def __init__(self, texts: list[bytes]):
        self.text = b" ".join(texts).translate(SPACES)
        letters = np.frombuffer(self.text, np.uint8)
        in_word = letters != 32
        edge = np.diff(np.concatenate(([False], in_word, [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.bounds = np.searchsorted(self.start, np.cumsum([0, *(len(t) + 1 for t in texts)])).astype(np.int64)
        self.sym = np.empty(len(self.start), np.uint64)
        for w in range(0, len(self.start), SLICE):
            a, b = self.start[w : w + SLICE], self.end[w : w + SLICE]
            base = int(a[0])
            up, down = _powers(int(b[-1]) - base + 1)
            total = np.zeros(int(b[-1]) - base + 1, np.uint64)
            np.cumsum(LETTERS[letters[base : int(b[-1])]] * down[: len(total) - 1], out=total[1:])
            self.sym[w : w + SLICE] = pair_names((total[b - base] - total[a - base]) * up[a - base], (b - a).astype(np.uint64))


class Recompression(Method):
    def __init__(self, window: int, rounds: int):
        self.window, self.rounds = window, rounds

    def prepare(self, texts):
        return Words(texts)

    def _views(self, own, shared, rounds):
        """Works on CHUNK tokens at a time; which symbols a window holds does not hang on what lies around it."""
        for at in range(0, max(0, len(own.sym) - self.window + 1), CHUNK):
            part = own.sym[at : at + CHUNK + self.window - 1]
            doc = np.searchsorted(own.bounds, np.arange(at, at + len(part)), "right")
            yield at, part, View(part, doc, self.window, shared, rounds)

    def propose(self, own, shared):
        out: tuple[list, list] = ([], [])
        for at, part, v in self._views(own, shared, len(shared) + 1):
            name, place = v.useful()
            if len(shared) == self.rounds - 1:
                bare = np.flatnonzero(v.alive & v.bare)
                name, place = np.concatenate([name, self._own(part, bare)]), np.concatenate([place, bare])
            out[0].append(name)
            out[1].append(place + at)
        return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def _own(self, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        return pair_names(names(part, self.window)[at], np.full(len(at), RUN)) if len(at) else np.zeros(0, np.uint64)

    def segments(self, own, shared):
        out: tuple[list, list, list] = ([], [], [])
        for at, part, v in self._views(own, shared, self.rounds):
            which, name = v.anchors()
            bare = np.flatnonzero(v.alive & v.bare)
            alone = self._own(part, bare)
            live = v.alive & ~v.bare
            on = member(alone, shared[-1])
            live[bare[on]] = True
            which[bare] = -2 - np.arange(len(bare))  # each by itself
            head = np.empty(v.m, bool)
            head[:1] = True
            head[1:] = (which[1:] != which[:-1]) | (live[1:] != live[:-1])
            first = np.flatnonzero(head)
            size = np.diff(np.append(first, v.m))
            keep = live[first]
            first, size = first[keep], size[keep]
            w = which[first]
            out[0].append(first + at)
            out[1].append(size)
            got = np.zeros(len(w), np.uint64)
            got[w >= 0], got[w < 0] = name[w[w >= 0]], alone[-2 - w[w < 0]]
            out[2].append(got)
        if not out[0]:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in out)

    def cut(self, own, at, size):
        return own.text[own.start[at] : own.end[at + size - 1]]

    def joined(self, pieces):
        return b"\n".join(pieces)

    def parted(self, blob, sizes):
        return blob.split(b"\n")

    def load(self, pieces):
        """Numbers of the words, one for each distinct word: they are equal where the words are."""
        words = b" ".join(pieces).split()
        index = {w: i for i, w in enumerate(dict.fromkeys(words))}
        return np.fromiter(map(index.__getitem__, words), np.uint64, len(words))

    def order(self, symbols, at):
        """By names of the windows; those that fall together are compared word by word."""
        h = names(symbols, self.window)[at]
        low = max(1, (len(at) - 1).bit_length())
        mask = np.uint64((1 << low) - 1)
        packed = (h & ~mask) | np.arange(len(at), dtype=np.uint64)
        packed.sort()
        order = (packed & mask).astype(np.int64)
        packed >>= np.uint64(low)
        new = np.r_[True, packed[1:] != packed[:-1]]
        x, again = at[order], np.flatnonzero(~new)
        bad = np.zeros(len(again), bool)
        for off in range(self.window):
            bad |= symbols[x[again] + off] != symbols[x[again - 1] + off]
        if bad.any():  # one name for two sequences: their windows are put in the order of their words
            group = np.cumsum(new) - 1
            for g in np.unique(group[again[bad]]).tolist():
                lo, hi = np.searchsorted(group, [g, g + 1])
                rows = symbols[x[lo:hi, None] + np.arange(self.window)]
                by = np.lexsort(rows.T[::-1])
                order[lo:hi] = order[lo:hi][by]
                new[lo + 1 : hi] = (rows[by][1:] != rows[by][:-1]).any(axis=1)
        return order, new
