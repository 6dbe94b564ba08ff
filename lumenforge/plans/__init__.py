"""Queries over the driver's tables: name -> callable, and name -> SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers f(read) as a query; read(table) gives a DataFrame, read.dir and read.spark the rest."""

    def put(f):
        key = name or f.__name__

        def run(spark, sf_dir):
            return f(Reader(spark, sf_dir))

        QUERIES[key] = run
        if sql:
            ORACLE[key] = sql
        return f

    return put


class Reader:
    def __init__(self, spark, sf_dir):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, table):
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")
