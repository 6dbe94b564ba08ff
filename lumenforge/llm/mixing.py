"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised; a is bisected to
the greatest value in [0, 1] whose entropy reaches ``entropy`` of the greatest possible
(log of the number of sources), then raised as far as the ``repeats`` limit asks.  A step is one
aggregate over the sources, of which there may be any number: it tries a row of exponents at once.  The
weights are realised as budgets of tokens: a source of budget B and T tokens goes round B // T
times, and a last time as far as B % T.  The order of a source is a permutation of blocks, and
of documents within a block: each document falls into a block by a hash, blocks and documents
are ordered by hashes, and token offsets are running sums, of blocks within a source and of
documents within a block, so no task sorts a whole source's documents; the blocks of a source are summed
by the first digits of their hash, so none sorts a source's blocks either.

Defined cases: a null source is a source of its own; null and empty texts have no tokens and are
used once each time round; a source without tokens has weight 0; repeated ids are rows of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored

TOKEN = r"[^\x20\x09-\x0D]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def exponent(sizes: DataFrame, entropy: float, repeats: float, budget_share: float, points: int = 256, steps: int = 4) -> tuple[float, float]:
    """The exponent, and the sum of the shares raised to it, for sizes(tokens), all positive."""
    one = sizes.agg(F.sum("tokens").cast("double").alias("t"), F.count("*").alias("n"), F.min("tokens").cast("double").alias("least")).first()
    total, n, least = one["t"], one["n"], one["least"]
    if not n:
        return 1.0, 1.0
    log, low = F.log(F.col("tokens") / F.lit(total)), math.log(least / total)
    fixed = lambda c: F.sum(c.cast("decimal(38,20)")).cast("double")  # noqa: E731  a sum that no order of rows changes

    def tried(grid: list[float]) -> list[tuple[float, float, float, float]]:
        """a, sum of powers, entropy and most repeats for each a."""
        power = F.exp(F.col("a") * log)
        rows = sizes.select("tokens", F.explode(F.lit(grid)).alias("a")).groupBy("a").agg(fixed(power).alias("z"), fixed(power * log).alias("s")).collect()  # a row for each exponent
        return sorted((r["a"], r["z"], math.log(r["z"]) - r["a"] * r["s"] / r["z"], budget_share * math.exp((r["a"] - 1) * low) / r["z"]) for r in rows)

    def bisect(good) -> tuple[float, float, float, float]:  # good holds from some exponent on
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            got = tried([lo + (hi - lo) * i / points for i in range(points + 1)])
            i = next((i for i, x in enumerate(got) if good(x)), points)
            if i == 0:
                return got[0]
            lo, hi, best = got[i - 1][0], got[i][0], got[i]
        return best

    need = entropy * math.log(max(1, n))
    best = tried([1.0])[0]
    if best[2] < need:
        best = bisect(lambda x: x[2] <= need)
    if best[3] > repeats:
        other = bisect(lambda x: x[3] <= max(repeats, budget_share))
        best = max(best, other)
    return best[0], best[1]


def source_plan(sizes: DataFrame, entropy: float, repeats: float, budget_share: float) -> DataFrame:
    """Adds weight and budget to sizes(source, tokens, ...)."""
    a, z = exponent(sizes.where("tokens > 0"), entropy, repeats, budget_share)
    total = sizes.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    weight = F.when(F.col("tokens") > 0, F.exp(a * F.log(F.col("tokens") / F.lit(float(total or 1)))) / z).otherwise(0.0)
    return sizes.withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * float(total * budget_share) + 0.5).cast("long"))


def mixed(docs: DataFrame, entropy: float = 0.98, repeats: float = 4.0, budget_share: float = 1.0, block: int = 1024, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, weight, copies and place (token offset in the source's order) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"))
    rows = stored(rows, "tokens")
    sizes = stored(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    plan = source_plan(sizes, entropy, repeats, budget_share).select(F.col("source").alias("s"), "tokens", "weight", "budget", F.ceil(F.col("docs") / block).cast("long").alias("blocks"))
    r = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("key", key).withColumn("block", F.pmod(number, F.col("blocks")))
    sums = r.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    turn = F.md5(F.concat_ws(":", F.lit(f"b{seed}"), F.col("block").cast("string")).cast("binary"))
    sums = sums.withColumn("turn", turn).withColumn("lead", F.substring("turn", 1, 3))
    heads = sums.groupBy("source", "lead").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("source").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    heads = heads.select(F.col("source").alias("s3"), F.col("lead").alias("l3"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("far"))
    w = Window.partitionBy("source", "lead").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("near", F.coalesce(F.sum("n").over(w), F.lit(0))).join(heads, F.col("source").eqNullSafe(F.col("s3")) & (F.col("lead") == F.col("l3")))
    sums = sums.select(F.col("source").alias("s2"), F.col("block").alias("b2"), (F.col("far") + F.col("near")).alias("before"))
    inner = Window.partitionBy("source", "block").orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    r = r.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    place = (F.col("before") + F.col("own")).alias("place")
    rounds = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(1))
    rest = F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(F.lit(0))
    return r.select("doc_id", "source", "n_tokens", "weight", (rounds + (place < rest).cast("long")).cast("long").alias("copies"), place)
