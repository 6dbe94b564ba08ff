"""Streams on keyed state: what a query that starts again from its checkpoint leaves is what one batch leaves."""

import json

import pytest

from lumenforge.operators import learners
from lumenforge.streaming import bandit as b

DDL = "grp long, seq long, arm string, reward double"


def rewards(n):
    return [(i % 3, i, "abc"[(i * 7) % 3], float((i * 13) % 11)) for i in range(n)]


def put(spark, path, rows, name):
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{path}/{name}")


@pytest.mark.parametrize("name", ["upperConfidenceBoundOne", "thompsonSampler", "exponentialWeight", "actionPursuit"])
def test_learner_goes_on_from_its_checkpoint(spark, tmp_path, name):
    """Two runs over files as they come give the actions and states of one learner that sees both parts."""
    rows, source, path = rewards(60), f"{tmp_path}/in", f"{tmp_path}/run"
    stream = lambda: b.learner_actions(spark.readStream.schema(DDL).parquet(f"{source}/*"), ["a", "b", "c"], name, 2, reward_scale=10.0)
    put(spark, source, rows[:30], "one")
    b.run_once(spark, stream(), "update", ["grp"], path)
    put(spark, source, rows[30:], "two")
    got = {r.grp: r for r in b.run_once(spark, stream(), "update", ["grp"], path).collect()}
    for g in range(3):
        want = learners.create(name, ["a", "b", "c"], reward_scale=10.0)
        for part in (rows[:30], rows[30:]):
            for _, _, a, r in (x for x in part if x[0] == g):
                want.set_reward(a, r)
            actions = [want.next_action() for _ in range(2)]
        assert got[g].actions == ",".join(actions) and got[g].seen == 20
        assert json.loads(got[g].state) == json.loads(want.state())
    again = {r.grp: r for r in b.run_once(spark, stream(), "update", ["grp"], path).collect()}  # nothing new
    assert again == got


def test_a_repeated_batch_overwrites_its_folder(spark, tmp_path):
    put(spark, f"{tmp_path}/in", rewards(9), "one")
    s = spark.readStream.schema(DDL).parquet(f"{tmp_path}/in/*")
    b.to_parquet(s, f"{tmp_path}/out", "append", f"{tmp_path}/c1").awaitTermination()
    b.to_parquet(s, f"{tmp_path}/out", "append", f"{tmp_path}/c2").awaitTermination()  # batch 0 once more
    assert sorted(map(tuple, b.read_batches(spark, f"{tmp_path}/out", s.schema, "append").collect())) == sorted(rewards(9))


def test_sessions_and_sliding_windows(spark, tmp_path):
    ddl = "user_id long, event_type string, ts timestamp, value double"
    rows = [(1, "a", f"2024-01-01 {h}", 1.0) for h in ("00:00:00", "00:30:00", "01:29:59", "04:00:00")]
    spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double").selectExpr("user_id", "event_type", "cast(ts as timestamp) ts", "value").write.parquet(f"{tmp_path}/in/one")
    stream = lambda: spark.readStream.schema(ddl).parquet(f"{tmp_path}/in/*")
    got = b.run_once(spark, b.sessions(stream(), "user_id"), "complete").collect()
    assert sorted((r.n, str(r.w.start)[11:16]) for r in got) == [(1, "04:00"), (3, "00:00")]
    got = b.run_once(spark, b.windowed(stream(), size="2 hours", slide="1 hour"), "complete").collect()
    assert sorted((str(r.w.start)[11:16], r.n) for r in got) == [("00:00", 3), ("01:00", 1), ("03:00", 1), ("04:00", 1), ("23:00", 2)]
