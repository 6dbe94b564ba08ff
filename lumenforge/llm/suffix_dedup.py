"""Suffix-array dedup: removes bytes of strings that an earlier document already has.

Strings that may repeat are brought together by content (of each 50 bytes the 24-byte run of least name, where two
documents have it; see ``repeats``).  The task that owns a slot joins its distinct stretches to a text and sorts the
suffixes that start a string blockwise (see ``suffix_order``): one bucket of first bytes at a time, long ties
resolved by ranks of a difference cover sample computed before.  Neighbours that agree in 50 bytes are one class;
its least doc_id decides.  The cover is taken of each slot's text: one of the whole corpus would let two
suffixes meet at an offset that differs from pair to pair, so each window would go to several owners (see the
README for figures).

Defined cases: null text counts as empty; a text shorter than the string length loses
nothing; rows with the same doc_id don't count as earlier than each other; a null doc_id
is later than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import parts
from .repeats import Method, arrow_schema, member, segments, windows_seen_before
from .suffix_order import suffix_order

OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
OUT_SPANS = OUT + ", spans string"


class Joined:
    def __init__(self, texts: list[bytes]):
        self.whole = b"".join(texts)
        self.sym, self.bounds = np.frombuffer(self.whole, np.uint8), np.cumsum([0, *map(len, texts)], dtype=np.int64)


class Suffixes(Method):
    rounds = 1

    def __init__(self, length: int, gram: int):
        self.window, self.gram = length, gram

    def prepare(self, texts):
        return Joined(texts)

    def propose(self, own, shared):
        at, _, name = segments(own.sym, own.bounds, self.window, self.gram)
        return name, at

    def segments(self, own, shared):
        at, count, name = segments(own.sym, own.bounds, self.window, self.gram)
        on = member(name, shared[0])
        return at[on], count[on], name[on]

    def cut(self, own, at, size):
        return own.whole[at : at + size]

    def load(self, pieces):
        return np.frombuffer(b"".join(pieces), np.uint8)

    def order(self, symbols, at):
        return suffix_order(symbols, at, self.window)


def drop_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 24, with_spans: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, start:end by commas, if with_spans)."""
    ddl = OUT_SPANS if with_spans else OUT

    def finish(ids, texts, bounds, cover):
        n, gone, runs, sha, spans = [], [], [], [], []
        for i, t in enumerate(texts):
            on = cover[bounds[i] : bounds[i + 1]]
            n.append(len(t))
            k = int(np.count_nonzero(on))
            gone.append(k)
            if not k:
                runs.append(0)
                sha.append(hashlib.sha256(t).hexdigest())
                spans.append("")
                continue
            edge = np.flatnonzero(np.diff(np.concatenate(([0], on.view(np.int8), [0]))))
            runs.append(len(edge) // 2)
            sha.append(hashlib.sha256(np.frombuffer(t, np.uint8)[~on].tobytes()).hexdigest())
            spans.append(",".join(f"{a}:{b}" for a, b in edge.reshape(-1, 2).tolist()) if with_spans else "")
        cols = [pa.array(ids, pa.int64()), n, gone, runs, sha] + [spans] * with_spans
        return pa.table(cols, schema=arrow_schema(ddl))

    return windows_seen_before(parts(docs), Suffixes(length, gram), finish, ddl, **options)
