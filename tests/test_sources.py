import json
import os

import pytest

from lumenforge.sources import files
from lumenforge.streaming import bandit
from pyspark.sql import functions as F

SCHEMA = json.dumps({"fields": [{"name": "id", "ordinal": 0, "id": True, "dataType": "string"}, {"name": "amount", "ordinal": 2, "dataType": "int", "feature": True, "bucketWidth": 10}, {"name": "kind", "ordinal": 1, "dataType": "categorical", "feature": True, "cardinality": ["a", "b"]}]})


def test_delimited_round_trip(spark, tmp_path):
    fields = files.feature_schema(SCHEMA)
    assert [f.name for f in fields] == ["id", "kind", "amount"] and fields[1].cardinality == ("a", "b")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.csv").write_text('u1, a ,15\nu2,"b,7\n')
    d = files.read_delimited(spark, str(tmp_path / "in"), fields)
    assert sorted(map(tuple, d.collect())) == [("u1", "a", 15), ("u2", '"b', 7)]
    assert {r.b for r in d.select(files.bucketed(fields[2]).alias("b")).collect()} == {0, 1}
    files.write_delimited(d, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "out"), fields).collect())) == sorted(map(tuple, d.collect()))
    files.write_by_length(spark.createDataFrame([(1, "a"), (2, "a,b")], "itemset_len int, items string"), str(tmp_path / "sets"))
    assert {p for p in os.listdir(tmp_path / "sets") if "=" in p} == {"itemset_len=1", "itemset_len=2"}


def test_local_predictions(spark):
    d = spark.createDataFrame([(1, 2.0)], "id long, x double")
    assert files.predict_with(d, lambda b: b.assign(y=b.x * 2)[["id", "y"]], "id long, y double").first().y == 4.0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(u, a, float(v), t) for t, (u, a, v) in enumerate([(1, "a", 1), (1, "b", 3), (1, "a", 2), (2, "b", 1), (2, "a", 5)])]
    src = str(tmp_path / "s")
    d = spark.createDataFrame(rows, "user_id long, event_type string, value double, i long")
    for part in (0, 1, 2):
        d.where(F.col("i") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = bandit.run_once(spark, bandit.learner(stream, "user_id", "event_type", "value"), "update", ["grp"], str(tmp_path / "ck"))
    last = out.groupBy("grp").agg(F.max_by("arm", "n").alias("arm"), F.max("n").alias("n"))
    assert {(r.grp, r.arm, r.n) for r in last.collect()} == {(1, "b", 3), (2, "a", 2)}


def test_paths_round_trip(spark, tmp_path):
    from lumenforge.operators import models

    d = spark.createDataFrame([(float(x), float(x % 3), x > 5) for x in range(12)], "a double, b double, y boolean")
    paths = models.grow_tree(d, F.col("y"), {"a": [2, 5, 8], "b": [0, 1]}, 2)
    files.write_paths(paths, spark, str(tmp_path / "m"))
    again = files.read_paths(spark, str(tmp_path / "m"))
    assert again == paths
    got = d.select("y", files.predict_paths(again).alias("p")).collect()
    assert all((r.p > 0.5) == r.y for r in got)


def test_properties_and_documents(spark, tmp_path):
    o = files.options_from_properties("# x\nn = 3\nflag=true\nnames=a,b\nrate=0.5\nkey=k", {"n": 1, "flag": False, "names": [""], "rate": 1.0, "key": None, "other": 7})
    assert o == {"n": 3, "flag": True, "names": ["a", "b"], "rate": 0.5, "key": "k", "other": 7}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_text("a\nb")
    r = files.read_documents(spark, str(tmp_path / "d")).first()
    assert r.text == "a\nb" and r.name.endswith("one.txt")


def test_rate_stream(spark):
    s = files.stream(spark, "rate", rowsPerSecond="5")
    assert s.isStreaming and s.columns == ["timestamp", "value"]


def test_transitions_across_batches(spark, tmp_path):
    src = str(tmp_path / "s")
    rows = [(1, 0, "a"), (2, 0, "b"), (1, 1, "b"), (1, 2, "a"), (2, 1, "b"), (1, 3, "b")]
    d = spark.createDataFrame(rows, "u long, i long, s string")
    for part in range(4):
        d.where(F.col("i") == part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    out = bandit.run_once(spark, bandit.transitions(stream, "u", ["i"], "s"), "append", path=str(tmp_path / "ck"))
    assert {(r.src, r.dst): r.n for r in out.groupBy("src", "dst").agg(F.sum("n").alias("n")).collect()} == {("a", "b"): 2, ("b", "a"): 1, ("b", "b"): 1}


def test_nested_settings():
    from lumenforge.sources.files import read_hocon, setting

    text = '''
    # jobs
    markov {
      field.delim.in = ","
      num.states : 5   // five
      on = true
      states = [ "L N", H, 3.5 ]
      nested { a = 1
        b { c = x y } }
    }
    rate = 0.25
    again = ${rate}
    markov { more = null }
    '''
    d = read_hocon(text)
    assert d["markov"]["states"] == ["L N", "H", 3.5] and d["markov"]["nested"] == {"a": 1, "b": {"c": "x y"}} and d["again"] == 0.25 and d["markov"]["more"] is None
    assert setting(d, "markov.field.delim.in", str) == "," and setting(d, "markov.num.states", float) == 5.0 and setting(d, "no", int, 7) == 7
    assert setting(d, "no", int, needed_if=False) is None
    for key, kind in (("no", int), ("rate", int), ("markov.on", int)):
        with pytest.raises(ValueError):
            setting(d, key, kind)


def test_keyed_store_reads_one_folder(spark, tmp_path):
    from lumenforge.sources.files import look_up, write_keyed

    rows = [(f"k{i % 50}", i, i / 2) for i in range(500)]
    write_keyed(spark.createDataFrame(rows, "src string, dst long, dist double"), "src", f"{tmp_path}/s", 8)
    got = look_up(spark, f"{tmp_path}/s", "src", "k7", 8)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] == "k7")
    assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= 8 and "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().toString()
    assert look_up(spark, f"{tmp_path}/s", "src", "none", 8).count() == 0


class Sent:
    def __init__(self, path):
        import uuid

        self.f = open(f"{path}/{uuid.uuid4().hex}", "w")

    def send(self, row):
        self.f.write(f"{row['a']}\n")

    def close(self):
        self.f.close()


def test_rows_are_sent_by_a_client_a_task(spark, tmp_path):
    import functools
    import os

    from lumenforge.sources.files import send_rows, write_two

    d = spark.range(100).selectExpr("id as a").repartition(3)
    os.mkdir(f"{tmp_path}/x")
    assert send_rows(d, functools.partial(Sent, f"{tmp_path}/x")) == 100
    got = sorted(int(x) for f in os.listdir(f"{tmp_path}/x") for x in open(f"{tmp_path}/x/{f}").read().split())
    assert got == list(range(100)) and 1 < len(os.listdir(f"{tmp_path}/x"))
    from pyspark.sql import functions as F

    write_two(d, f"{tmp_path}/m", f"{tmp_path}/n", F.col("a") >= 90)
    assert spark.read.parquet(f"{tmp_path}/m").count() == 90 and spark.read.parquet(f"{tmp_path}/n").count() == 10
