"""Substring dedup by recompression: removes words that an earlier document already has.

Two rounds over all documents name runs of words and pairs of neighbours (see ``recompression``), so that equal
substrings hold equal interior symbols; each round's names are gathered in Spark, and tell the next which of them two
documents share.  Windows all of whose interior symbols are shared are sent, as words, to the owner of their
high-level symbol, who compares them word by word (see ``repeats``).

Defined cases: null text counts as empty (0 words, hash of the empty string); a document
shorter than the window loses nothing; rows with the same doc_id don't count as earlier
than each other; a null doc_id is later than all others; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import parts
from .recompression import Recompression
from .repeats import arrow_schema, windows_seen_before

OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
OUT_TEXT = OUT + ", kept string"


def drop_repeated_words(docs: DataFrame, window: int = 13, rounds: int = 2, with_text: bool = False, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the words that stay, if with_text).

    A word goes if a window of ``window`` consecutive words that covers it also starts in
    a document of smaller doc_id.  Words are runs of bytes other than space and \\t-\\r.
    """
    ddl = OUT_TEXT if with_text else OUT

    def finish(ids, texts, bounds, cover):
        n, gone, sha, kept = [], [], [], []
        for i, t in enumerate(texts):
            w, on = t.split(), cover[bounds[i] : bounds[i + 1]]
            n.append(len(w))
            k = int(on.sum())
            gone.append(k)
            left = b" ".join(w if not k else [x for x, c in zip(w, on.tolist(), strict=True) if not c])
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode() if with_text else "")
        cols = [pa.array(ids, pa.int64()), n, gone, sha] + [kept] * with_text
        return pa.table(cols, schema=arrow_schema(ddl))

    return windows_seen_before(parts(docs), Recompression(window, rounds), finish, ddl, **options)
