"""Frequent item sets level by level, rules, and masking of rare items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def frequent(baskets: DataFrame, level: int, support: float) -> DataFrame:
    """Item sets (i1 .. ik sorted) of size ``level`` whose share of transactions exceeds ``support``.

    baskets: tid, item, distinct.  Each level keeps only items that are frequent by themselves, so
    the join within a transaction is on what can still count.
    """
    total = baskets.agg(F.countDistinct("tid").alias("total"))
    one = baskets.groupBy("item").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > support * F.col("total"))
    kept = baskets.join(one.select("item"), "item", "left_semi")
    sets = kept.select("tid", F.col("item").alias("i1"))
    for k in range(2, level + 1):
        sets = sets.join(kept.select("tid", F.col("item").alias(f"i{k}")), "tid").where(F.col(f"i{k}") > F.col(f"i{k - 1}"))
        if k < level:
            cols = [f"i{j}" for j in range(1, k + 1)]
            good = sets.groupBy(*cols).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > support * F.col("total")).select(*cols)
            sets = sets.join(good, cols, "left_semi")
    cols = [f"i{j}" for j in range(1, level + 1)]
    out = sets.groupBy(*cols).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") > support * F.col("total"))
    return out.select(*cols, "n", (F.col("n") / F.col("total")).alias("support"))


def rules(pairs: DataFrame, items: DataFrame, confidence: float) -> DataFrame:
    """a -> b and b -> a from frequent pairs and single items; confidence is a ratio of counts."""
    both = pairs.select(F.explode(F.array(F.struct(F.col("i1").alias("ante"), F.col("i2").alias("cons"), "n", "support"), F.struct(F.col("i2").alias("ante"), F.col("i1").alias("cons"), "n", "support"))).alias("x")).select("x.*")
    one = items.select(F.col("i1").alias("ante"), F.col("n").alias("n_ante"))
    out = both.join(one, "ante").withColumn("confidence", F.col("n") / F.col("n_ante"))
    return out.where(F.col("confidence") > confidence).select("ante", "cons", "support", "confidence")


def mark_infrequent(baskets: DataFrame, items: DataFrame, marker: str) -> DataFrame:
    return baskets.join(items.select(F.col("i1").alias("item"), F.lit(True).alias("_f")), "item", "left").select("tid", F.when(F.col("_f"), F.col("item")).otherwise(marker).alias("item"))


def _of_total(counts: DataFrame, total: DataFrame, keys: list[str], support: float) -> DataFrame:
    x = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))  # one row without keys
    return x.where(F.col("n") > support * F.col("total"))


def item_sets(baskets: DataFrame, most: int, support: float, by: list[str] | None = None) -> DataFrame:
    """by..., items (a sorted array), n, support: frequent sets of one to ``most`` items, in each partition ``by`` itself.

    baskets: by..., tid, item.  Transactions of the same items count as one, with their number.  A level extends the
    sets of each that are still frequent by items that are frequent by themselves and come later; a set carries those
    of its transaction, so that no level joins or shuffles transactions, but counts of sets only.
    """
    keys = by or []
    whole = baskets.groupBy(*keys, "tid").agg(F.sort_array(F.collect_set("item")).alias("_all"))
    # what the levels read, and read again, is the distinct transactions; the key of one of them stands for all
    whole = stored(whole.groupBy(*keys, "_all").agg(F.min("tid").alias("tid"), F.count("*").alias("_w")), "baskets")
    total = whole.groupBy(*keys).agg(F.sum("_w").alias("total"))
    rows = whole.select(*keys, "tid", "_w", F.explode("_all").alias("item"))
    every = stored(rows.groupBy(*keys, "item").agg(F.sum("_w").alias("n")), "items")
    one = stored(_of_total(every, total, keys, support), "sets")
    kept = whole
    if one.count() < every.count():
        kept = rows.join(one.select(*keys, "item"), [*keys, "item"], "left_semi").groupBy(*keys, "tid").agg(F.max("_w").alias("_w"), F.sort_array(F.collect_list("item")).alias("_all"))
        kept = stored(kept, "baskets")
    held = kept.select(*keys, "_w", F.array().cast(kept.schema["_all"].dataType).alias("items"), F.col("_all").alias("_rest"))
    out = None
    for level in range(1, most + 1):
        held = held.select("*", F.posexplode("_rest").alias("_at", "_item"))
        held = held.select(*keys, "_w", F.array_append("items", F.col("_item")).alias("items"), F.slice("_rest", F.col("_at") + 2, F.size("_rest")).alias("_rest"))
        if level == 1:
            good = one.withColumn("items", F.array("item"))
        else:
            good = stored(_of_total(held.groupBy(*keys, "items").agg(F.sum("_w").alias("n")), total, keys, support), "sets")
            held = held.join(good.select(*keys, "items"), [*keys, "items"], "left_semi")
        good = good.select(*keys, "items", "n", (F.col("n") / F.col("total")).alias("support"))
        out = good if out is None else out.unionByName(good)
    return out


def _parts(items: Column, most: int) -> Column:
    """All parts of an array of 1 to ``most`` items that leave one at least."""
    every = F.transform(F.sequence(F.lit(1), (F.pow(F.lit(2.0), F.size(items)) - 2).cast("int")), lambda mask: F.filter(items, lambda x, i: F.floor(mask / F.pow(F.lit(2.0), i)) % 2 == 1))
    return F.filter(every, lambda a: F.size(a) <= most)


def set_rules(sets: DataFrame, most: int, confidence: float, by: list[str] | None = None) -> DataFrame:
    """by..., ante, cons, support, confidence: rules from antecedents of up to ``most`` items, for all sets of ``item_sets``."""
    keys = by or []
    split = sets.where(F.size("items") > 1).select(*keys, "items", "n", "support", F.explode(_parts(F.col("items"), most)).alias("ante"))
    known = sets.select(*keys, F.col("items").alias("ante"), F.col("n").alias("n_ante"))
    out = split.join(known, [*keys, "ante"]).withColumn("confidence", F.col("n") / F.col("n_ante"))
    return out.where(F.col("confidence") > confidence).select(*keys, "ante", F.array_except("items", "ante").alias("cons"), "support", "confidence")
