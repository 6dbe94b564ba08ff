"""All queries of the library (the training-data ones apart) and their SQL."""

from __future__ import annotations

from .plans import ORACLE, QUERIES  # noqa: F401
from .plans import association, bandits, contingency, describe, explore, information, learning, models, routing, scalars, sequence_more, sequences, series, similarity, simulate, sql, stream, text, text_more, twosample  # noqa: F401

if unknown := set(sql.SQL) - set(QUERIES):
    raise ImportError(f"SQL without a query: {sorted(unknown)}")
ORACLE.update(sql.SQL)
