"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

__all__ = ["ascii_lower", "crc_mod", "parts", "stored", "text_bytes", "without_rows"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a column, over all rows."""
    return docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0


def parts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and the text alone, named doc_id and text; other columns can't clash then."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def without_rows(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """The rows of docs, all columns, whose (doc_id, key) is not in gone(doc_id, key).  Rows are told apart by both: ids may repeat."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), key.alias("k"))
    gone = gone.select(F.col("doc_id").alias("gone_d"), F.col("key").alias("gone_k"))
    return rows.join(gone, F.col("d").eqNullSafe(F.col("gone_d")) & (F.col("k") == F.col("gone_k")), "left_anti").select("row.*")
