"""Connected components over links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import removed, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links(a, b), of any one orderable type; component is its least node.

    Rounds rewrite the links until they are stars about the least nodes; each is written to
    the shared folder, so a lost executor costs one round, and the round before it is deleted.  Nothing comes
    to the driver but a count and a checksum.  A node that is linked to itself alone has no row; links
    with a null end count for nothing.  Raises if the stars don't settle.
    """
    spark, kind = links.sparkSession, dict(links.dtypes)["a"]
    place = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        e = spark.read.schema(f"u {kind}, v {kind}").parquet(place)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        last, place = place, written(small, "links")
        removed(spark, [last])
        e = spark.read.schema(f"u {kind}, v {kind}").parquet(place)
        now = tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
