"""Files in the folder that all executors share: where lineage ends, and what is used twice."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset and Spark is local (tests), a folder made here."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenforge"))
        got = spark.sparkContext.getCheckpointDir()
    return got


def written(df: DataFrame, tag: str) -> str:
    """Writes df to a new place in the shared folder; gives the place."""
    path = f"{shared_dir(df.sparkSession)}/lumenforge/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (held := _written.get()) is not None:
        held.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df by way of a file in the shared folder, so that its lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, tag))


def removed(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """make()'s rows by way of a file; what make() stored on its way is deleted then."""
    token = _written.set([])
    try:
        out = stored(make(), tag)
        paths = (_written.get() or [])[:-1]
    finally:
        _written.reset(token)
    removed(spark, paths)
    return out
