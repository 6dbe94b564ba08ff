"""Exact dedup by an extendible-hash index on shared files.

1. *Index.*  Each task normalises its texts (A-Z lower-cased), hashes them, and compares the
   bytes of texts whose hash it has just met: only the first of equal texts in a task carries
   its text, so a text that a third of all rows hold travels once from each task.  The rows go
   to files in the shared folder.
2. *Keys.*  A hash that one text alone has needs no comparison: its entry is a class.  Hashes with more entries
   are counted, with the bytes they bring, before any text moves.
3. *Directory.*  The directory starts with as many bits as buckets of the capacity need on average.  A bucket over
   capacity with more than one hash is split at its next bit, which doubles the directory there, until none is
   left; this runs on the counted hashes, in Spark, and nothing but a count comes to the driver.
4. *Owners.*  The task of a bucket gets the texts of its key range, chains those whose hashes collide,
   and compares bytes; each chain entry is a class.  Texts come by two levels, so that a hash that every task has
   meets a part of the tasks first, then one text of each part.
5. *Classes.*  The greatest doc_id and the size, aggregated before the shuffle.

Defined cases: null text counts as empty; a null doc_id loses against any other (keep_id
is null only in a class that has no other id); repeated ids are rows of their own and
all rows with the kept id count as kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, parts, stored, without_rows
from .repeats import arrow_schema

INDEX = "row long, doc_id long, hash long, text_sha256 string, leader long, text binary"
CACHE = 32 << 20


def indexed(docs: DataFrame, cache: int = CACHE) -> DataFrame:
    def run(batches):
        import xxhash
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 36
        held: dict[int, list[tuple[bytes, int]]] = {}
        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                out = [[] for _ in range(6)]
                for i, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    x = (t or "").encode().lower()
                    h = xxhash.xxh3_64_intdigest(x) - (1 << 63)
                    leader = next((r for y, r in held.get(h, ()) if y == x), None)
                    own = leader is None
                    if own:
                        leader = n
                        size += len(x) + 200
                        if size > cache:  # forgets; a later equal text carries its bytes again
                            held, size = {}, len(x) + 200
                        held.setdefault(h, []).append((x, n))
                    for c, v in zip(out, (n, i, h, hashlib.sha256(x).hexdigest(), leader, x if own else None), strict=True):
                        c.append(v)
                    n += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, arrow_schema(INDEX), strict=True)], schema=arrow_schema(INDEX))

    return parts(docs).mapInArrow(run, INDEX)


def directory(keys: DataFrame, capacity: int, most: int = 40) -> DataFrame:
    """hash, slot of keys(hash, weight): the bucket, by its depth and its bits of the hash.

    Depth grows until no bucket of several hashes weighs more than capacity, ``most`` bits at most (buckets of so
    few hashes that this matters don't occur; they would be greater than capacity, not wrong).
    """
    total = keys.agg(F.sum("weight").alias("w")).first()["w"] or 0
    depth = min(most, max(1, (total // max(1, capacity)).bit_length()))
    high = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    rows = keys.withColumn("depth", F.lit(depth))
    bits = F.expr("shiftrightunsigned(h, 64 - depth)")
    rows = stored(rows.withColumn("h", high).withColumn("bits", bits), "directory")
    while True:
        full = rows.groupBy("depth", "bits").agg(F.sum("weight").alias("w"), (F.min("h") != F.max("h")).alias("several"))
        full = full.where((F.col("w") > capacity) & F.col("several") & (F.col("depth") < most)).select("depth", "bits", F.lit(1).alias("more"))
        if full.isEmpty():
            break
        rows = rows.join(full, ["depth", "bits"], "left").select("hash", "weight", "h", (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        rows = stored(rows.withColumn("bits", bits), "directory")
    return rows.select("hash", F.expr("bits + shiftleft(1L, depth)").alias("slot"))  # a leading bit tells depths apart


def chained(table: pa.Table) -> pa.Table:
    """One level of an owner: slot, hash, leader, text of a bucket; adds the class, the first leader of its chain."""
    chains: dict[int, list[tuple]] = {}
    leader, cls = table.column("leader").to_numpy(), []
    order = np.argsort(leader, kind="stable")
    hashes, text = table.column("hash").to_numpy(), table.column("text").combine_chunks()
    for i in order.tolist():
        x, links = text[i].as_buffer(), chains.setdefault(int(hashes[i]), [])
        for y, c in links:
            if y.equals(x):
                cls.append(c)
                break
        else:
            links.append((x, int(leader[i])))
            cls.append(int(leader[i]))
    return table.take(pa.array(order)).append_column("class", pa.array(cls, pa.int64()))


def owners(index: DataFrame, capacity: int = 8 << 20) -> DataFrame:
    """(leader, class) of leaders whose hash has several: the class is the first leader in its chain."""
    leaders = index.where(F.col("text").isNotNull())
    keys = leaders.groupBy("hash").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + 64).alias("weight")).where("n > 1")
    slots = directory(keys.select("hash", "weight"), capacity)
    dealt = leaders.join(slots, "hash").select("slot", F.pmod(F.shiftright("row", 36), F.lit(64)).alias("part"), "hash", "leader", "text")

    def first(table):
        got = chained(table)
        head = pc.equal(got["leader"], got["class"])
        text = pc.if_else(head, got["text"], pa.scalar(None, pa.binary()))
        return pa.table([got["slot"], got["hash"], got["leader"], got["class"], text], names=["slot", "hash", "leader", "first", "text"])

    def last(table):
        got = chained(table)
        return pa.table([got["leader"], got["class"]], names=["first", "class"])

    one = stored(dealt.groupBy("slot", "part").applyInArrow(first, "slot long, hash long, leader long, first long, text binary"), "chains")
    two = one.where(F.col("text").isNotNull()).select("slot", "hash", "leader", "text").groupBy("slot").applyInArrow(last, "first long, class long")
    return one.select("leader", "first").join(two, "first").select("leader", "class")


def exact_duplicates(docs: DataFrame, capacity: int = 8 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs."""
    index = stored(indexed(docs), "index")
    cls = owners(index, capacity)
    rows = index.select("doc_id", "text_sha256", "leader").join(cls, "leader", "left").select("doc_id", "text_sha256", F.coalesce("class", "leader").alias("class"))
    rows = stored(rows, "classes")
    # stored: the join is then dealt anew, so that a class with a third of all rows can be split
    groups = stored(rows.groupBy("class").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, "class").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that ``exact_duplicates`` keeps: of equal texts all rows with the greatest doc_id."""
    gone = exact_duplicates(docs).where("not kept").select("doc_id", F.col("text_sha256").alias("key")).distinct()
    return without_rows(docs, gone, F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256))
