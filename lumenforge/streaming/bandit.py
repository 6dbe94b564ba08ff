"""Streaming: windows, sessions, transition counts and bandit learners on keyed state.

Results go to parquet by way of foreachBatch, a folder for each batch, which a repeated batch overwrites; so
a query that starts again from its checkpoint leaves what one that never stopped would.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import learners
from ..sources.shared import shared_dir


def to_parquet(stream: DataFrame, path: str, mode: str, checkpoint: str, **trigger):
    """Starts a query that writes each batch to a folder of its own; trigger: as writeStream's (all available data, once, if none)."""

    def put(df, batch):
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(put).start()


def read_batches(spark: SparkSession, path: str, schema, mode: str, keys: list[str] | None = None) -> DataFrame:
    """The result as it stands: all batches (append), the last one (complete), or each key's last row (update)."""
    rows = spark.read.schema(schema.add("batch", "long") if "batch" not in schema.names else schema).parquet(path)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("_last"))
        return rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("batch", "_last")
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(*keys, "x.*")


def run_once(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Runs all input available, into files of the shared folder (or of ``path``, from its checkpoint), and gives the result."""
    from copy import deepcopy

    path = path or f"{shared_dir(spark)}/lumenforge/stream-{uuid.uuid4().hex}"
    to_parquet(stream, f"{path}/out", mode, f"{path}/checkpoint").awaitTermination()
    return read_batches(spark, f"{path}/out", deepcopy(stream.schema), mode, keys)


def source(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)


def windowed(stream: DataFrame, late: str = "10 minutes", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and totals by tumbling windows, or by windows that start every ``slide``."""
    e = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, key: str, late: str = "10 minutes", gap: str = "1 hour") -> DataFrame:
    """Counts and totals by sessions of each key: events less than ``gap`` apart."""
    e = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def learner_actions(stream: DataFrame, arms: list[str], name: str, batch: int = 1, **options) -> DataFrame:
    """grp, seen, actions, state: any of the learners on keyed state.

    stream: grp, seq, arm, reward.  In each micro-batch a group takes its rewards in, in order of seq, and gives
    ``batch`` actions; the learner's whole state is kept from batch to batch.
    """

    def step(key, came, held: GroupState):
        learner = learners.create(name, arms, **options).load(held.get[0] if held.exists else None)
        rows = pd.concat(list(came)).sort_values("seq")
        for a, r in zip(rows["arm"], rows["reward"]):
            learner.set_reward(a, r)
        actions = [learner.next_action() for _ in range(batch)]
        held.update((learner.state(),))
        yield pd.DataFrame({"grp": [key[0]], "seen": [sum(learner.n.values())], "actions": [",".join(actions)], "state": [learner.state()]})

    kind = dict(stream.dtypes)["grp"]
    return stream.select("grp", "seq", "arm", "reward").groupBy("grp").applyInPandasWithState(step, f"grp {kind}, seen long, actions string, state string", "state string", "update", "NoTimeout")


def learner(stream: DataFrame, group: str, arm: str, reward: str) -> DataFrame:
    """State of each group: count and sum of rewards by arm; emits the best arm so far.

    Untried arms are not known to a group; ties go to the lesser name.
    """

    def step(key, batches, state: GroupState):
        held = dict(zip(*state.get)) if state.exists else {}
        arms = {a: tuple(map(float, v.split(","))) for a, v in held.items()}
        for b in batches:
            for a, x in zip(b[arm], b[reward]):
                n, s = arms.get(a, (0.0, 0.0))
                arms[a] = (n + 1, s + x)
        names = sorted(arms)
        state.update((names, [f"{arms[a][0]!r},{arms[a][1]!r}" for a in names]))
        best = max(names, key=lambda a: (round(arms[a][1] / arms[a][0], 9), [-ord(c) for c in a]))
        yield pd.DataFrame({"grp": [key[0]], "arm": [best], "n": [int(sum(v[0] for v in arms.values()))]})

    return stream.select(group, arm, reward).groupBy(group).applyInPandasWithState(step, "grp long, arm string, n long", "arms array<string>, stats array<string>", "update", "NoTimeout")


def transitions(stream: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """src, dst, n as they come: each key's last state is kept from batch to batch (rows of a batch are put in order)."""

    def step(k, batches, held: GroupState):
        pdf = pd.concat(list(batches)).sort_values(order)
        last = held.get[0] if held.exists else None
        seen = [last, *pdf[state]] if last is not None else list(pdf[state])
        held.update((seen[-1],))
        pairs = pd.DataFrame({"src": seen[:-1], "dst": seen[1:]})
        yield pairs.groupby(["src", "dst"], as_index=False).size().rename(columns={"size": "n"}).astype({"n": "int64"}) if len(pairs) else pd.DataFrame({"src": pd.Series([], dtype=str), "dst": pd.Series([], dtype=str), "n": pd.Series([], dtype="int64")})

    return stream.select(key, *order, state).groupBy(key).applyInPandasWithState(step, "src string, dst string, n long", "last string", "append", "NoTimeout")
