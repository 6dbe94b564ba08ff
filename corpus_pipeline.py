"""Cleaning of a corpus in five stages, each an operator of lumenforge.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents.  run() writes each result to the shared folder and rereads it; what a stage stored on its way is
deleted then.

Defined cases, of every stage: a row is told from others by doc_id and text, so repeated and null ids lose no
text; rows alike in both stay or go together; columns of any further names pass through; an empty table gives no rows.
Null and empty texts go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.llm import decontaminate, exact_dedup, langid, mixing, simhash_dedup
from lumenforge.sources.shared import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts and texts without a letter.

    The decoder itself rejects a text with letters only if the training rows name a language `und` and it
    predicts that.  Where no row has a language to learn from, all texts with letters stay.
    """
    model = langid.train(docs, F.lit(True))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = [model.decode(t)[0] != "und" if model.langs else langid.has_letter(t) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the greatest doc_id stays, a null one only where no other is."""
    return exact_dedup.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the least doc_id stays, a null one only where no other is."""
    return simhash_dedup.without_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's copies and place under temperature mixing of the sources."""
    return mixing.mixed(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("benchmark decontamination", benchmark), ("mixing", mix)]
ORACLE_SQL = None  # languages, fingerprints and the latent index are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
