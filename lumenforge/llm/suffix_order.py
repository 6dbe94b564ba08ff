"""Suffixes in order by blockwise sorting with a difference cover.

The cover {0, 1, 3, 9} modulo 13 holds two residues for every difference, so any two places reach the cover
together after 12 steps at most.  The places of the cover are ranked first, by 13 bytes, then by pairs of
ranks of 26 and 52 bytes (a place 13 further is a place of the cover too).  The suffixes asked for are then sorted one
bucket of first bytes at a time: by 13 bytes, and where these agree by the rank of the places of the cover that the
two reach together.  Sorting runs on numbers that hold a key above and an index below, so that no sort is indirect.
"""

from __future__ import annotations

import numpy as np

from .repeats import spread, starts_of

V, COVER = 13, (0, 1, 3, 9)
DEPTH = 4 * V  # bytes that ranks tell apart
BUCKET = 1 << 20
_AT = {c: i for i, c in enumerate(COVER)}


def _meeting() -> tuple[np.ndarray, np.ndarray]:
    """For residues a, b: places of the cover from the block's first to the one where both are in the cover."""
    one, two = np.zeros((V, V), np.int64), np.zeros((V, V), np.int64)
    for a in range(V):
        for b in range(V):
            d = next(d for d in range(V) if (a + d) % V in _AT and (b + d) % V in _AT)
            one[a, b] = (a + d) // V * len(COVER) + _AT[(a + d) % V]
            two[a, b] = (b + d) // V * len(COVER) + _AT[(b + d) % V]
    return one, two


ONE, TWO = _meeting()


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, the first the most significant, without a copy; text is padded."""
    return np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))


def _sorted(keys: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Indices in the order of keys (array, bits), the first counting most."""
    n = len(keys[0][0])
    low = max(1, (n - 1).bit_length())
    mask = np.uint64((1 << low) - 1)
    order, run = None, []
    for key, bits in reversed(keys):  # the last key first; keys that fit one number together are sorted at once
        if run and sum(b for _, b in run) + bits + low > 64:
            order, run = _pass(run, low, mask, order), []
        run.insert(0, (key, bits))
    return _pass(run, low, mask, order)


def _pass(run: list, low: int, mask: np.uint64, order: np.ndarray | None) -> np.ndarray:
    packed = run[0][0].astype(np.uint64)
    for key, bits in run[1:]:
        packed <<= np.uint64(bits)
        packed |= key.astype(np.uint64)
    if order is not None:
        packed = packed[order]
    packed <<= np.uint64(low)
    packed |= np.arange(len(packed), dtype=np.uint64)
    packed.sort()
    packed &= mask
    at = packed.astype(np.int64)
    return at if order is None else order[at]


def _thirteen(text: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The 13 bytes at each place as keys."""
    four = np.ndarray((len(text) - 3,), ">u4", text, strides=(1,))
    return [(four[at], 32), (four[at + 4], 32), (four[at + 8], 32), (text[at + 12], 8)]


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where one of the keys, in order, differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _ranked(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def cover_ranks(text: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the cover's places of n bytes of text, padded with DEPTH bytes at least; equal where DEPTH bytes are."""
    at = (np.arange(0, n, V)[:, None] + np.array(COVER)).ravel()
    order, wide = _sorted(_thirteen(text, at)), _words(text)
    x = at[order]
    rank = _ranked(order, _heads(wide[x], wide[x + 5]))
    for step in (1, 2):
        later = np.zeros(len(rank), np.int64)
        later[: -step * len(COVER)] = rank[step * len(COVER) :]
        bits = int(rank.max()).bit_length()
        order = _sorted([(rank, bits), (later, bits)])
        rank = _ranked(order, _heads(rank[order], later[order]))
    return rank


def settle(order: np.ndarray, at: np.ndarray, head: np.ndarray, rank: np.ndarray) -> None:
    """Puts indices whose places ``at`` agree in V bytes in the order of ranks, all groups at once: parted by a place of
    each group into those before, level and after, and so on with the parts.
    """
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(order)))
    first, size = first[size > 1], size[size > 1]
    turn = 0
    while len(first):
        index, base = order[spread(first, size)], starts_of(size)
        p = at[index]
        block = p // V
        rest = p - block * V
        block *= len(COVER)
        pivot = base + (size // 2 + turn * 7919) % size
        q = np.repeat(rest[pivot], size)
        mine, other = rank[block + ONE[rest, q]], rank[np.repeat(block[pivot], size) + TWO[rest, q]]
        less, more = mine < other, mine > other
        n_less, n_more = np.add.reduceat(less, base, dtype=np.int64), np.add.reduceat(more, base, dtype=np.int64)
        n_same = size - n_less - n_more
        if n_less.any() or n_more.any():
            for on, skip in ((less, 0), (~less & ~more, n_less), (more, n_less + n_same)):
                i = np.cumsum(on) - on
                to = i + np.repeat(first + skip - i[base], size)
                order[to[on]] = index[on]
        first, size = np.concatenate([first, first + n_less + n_same]), np.concatenate([n_less, n_more])
        first, size = first[size > 1], size[size > 1]
        turn += 1


def suffix_order(text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``at`` by the order of the suffixes there, and whether each differs from the one before it in
    its first ``length`` bytes, DEPTH at most.
    """
    if length > DEPTH:
        raise ValueError(f"at most {DEPTH} bytes are told apart")
    n = len(text)
    text = np.concatenate([text, np.zeros(2 * DEPTH, np.uint8)])
    rank = cover_ranks(text, n + V)  # a place reaches the cover 12 steps further at most
    wide = _words(text)
    lead = (wide[at] >> np.uint64(48)).astype(np.int64)
    many = np.bincount(lead, minlength=1 << 16)
    order, start, total = np.empty(len(at), np.int64), 0, np.cumsum(many)
    edges = [0]
    while edges[-1] < 1 << 16:  # buckets of first two bytes, as many as fit
        done = total[edges[-1] - 1] if edges[-1] else 0
        edges.append(max(edges[-1] + 1, int(np.searchsorted(total, done + BUCKET, "right"))))
    for lo, hi in zip(edges, edges[1:], strict=False):
        mine = np.flatnonzero((lead >= lo) & (lead < hi)) if len(edges) > 2 else np.arange(len(at))
        if not len(mine):
            continue
        place = at[mine]
        got = _sorted(_thirteen(text, place))
        x = place[got]
        settle(got, place, _heads(wide[x], wide[x + 5]), rank)
        order[start : start + len(mine)] = mine[got]
        start += len(mine)
    x = at[order]
    new = np.ones(len(x), bool)
    same = np.arange(1, len(x))
    for off in [*range(0, length - 7, 8), length - 8]:
        same = same[wide[x[same] + off] == wide[x[same - 1] + off]]
    new[same] = False
    return order, new

