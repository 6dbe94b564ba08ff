from pyspark.sql import functions as F

from ..operators import learners
from ..streaming import bandit as b
from . import query


def _stream(read):
    """The driver's events file as a stream: a file source reads its folder."""
    path = f"{read.dir}/events.parquet"
    schema = read.spark.read.parquet(path).schema
    return read.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(f"{read.dir}/events*")


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1,2")
def stream_windows(read):
    out = b.run_once(read.spark, b.windowed(_stream(read)), "complete")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 4).alias("total"))


@query("WITH m AS (SELECT user_id, event_type, round(sum(value)/count(*),9) m FROM events GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_type) rn FROM m), c AS (SELECT user_id, count(*) n FROM events GROUP BY 1) SELECT r.user_id AS grp, event_type AS arm, n FROM r JOIN c ON r.user_id=c.user_id WHERE rn=1")
def stream_bandit(read):
    return b.run_once(read.spark, b.learner(_stream(read), "user_id", "event_type", "value"), "update", ["grp"])


@query("WITH t AS (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) src, event_type dst FROM events) SELECT src, dst, count(*) AS n FROM t WHERE src IS NOT NULL GROUP BY 1,2")
def stream_transition_counts(read):
    out = b.run_once(read.spark, b.transitions(_stream(read), "user_id", ["ts", "event_id"], "event_type"), "append")
    return out.groupBy("src", "dst").agg(F.sum("n").alias("n"))


@query("SELECT event_type, t + INTERVAL (h*6) HOUR AS start, count(*) AS n, round(sum(value),4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) t FROM events), (SELECT unnest([0,-1,-2,-3]) h) GROUP BY 1,2")
def stream_sliding(read):
    """Windows of a day that start every six hours."""
    out = b.run_once(read.spark, b.windowed(_stream(read), slide="6 hours"), "complete")
    return out.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, value, (ts-lag(ts) OVER w < INTERVAL 1 HOUR)::INT j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(1-coalesce(j,0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value),4) AS total FROM s GROUP BY user_id, s")
def stream_sessions(read):
    """Sessions of each user: events less than an hour apart."""
    out = b.run_once(read.spark, b.sessions(_stream(read), "user_id"), "complete")
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


def _actions(name):
    def f(read):
        e = _stream(read).select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), F.col("event_type").alias("arm"), F.col("value").alias("reward"))
        arms = [r[0] for r in read("events").select("event_type").distinct().collect()]  # a row for each event type
        return b.run_once(read.spark, b.learner_actions(e, arms, name, 2, reward_scale=500.0), "update", ["grp"]).select("grp", "actions")

    return f


for _n in learners.LEARNERS:
    query(name=f"stream_{_n}")(_actions(_n))
