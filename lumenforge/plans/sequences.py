from pyspark.sql import functions as F

from ..operators import sequences as s
from ..operators.contingency import rounded
from . import query

ORDER = ["ts", "event_id"]
T = "t AS (SELECT user_id k, lag(event_type) OVER w src, event_type dst, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _c(read, by=None):
    return s.transition_counts(read("events"), "user_id", ORDER, "event_type", by)


@query(f"WITH {T} SELECT src, dst, count(*) AS n FROM t WHERE src IS NOT NULL GROUP BY 1,2")
def transition_counts(read):
    return _c(read)


@query(f"WITH {T}, c AS (SELECT src, dst, count(*) n FROM t WHERE src IS NOT NULL GROUP BY 1,2) SELECT src, dst, n, round(n/sum(n) OVER (PARTITION BY src),9) AS p FROM c")
def transition_prob(read):
    return rounded(s.normalised(_c(read)), 9)


@query(f"WITH {T}, c AS (SELECT src, dst, count(*) n FROM t WHERE src IS NOT NULL GROUP BY 1,2), e AS (SELECT DISTINCT event_type e FROM events), f AS (SELECT a.e src, b.e dst, coalesce(n,0)+1 n FROM e a CROSS JOIN e b LEFT JOIN c ON c.src=a.e AND c.dst=b.e) SELECT src, dst, n, round(n/sum(n) OVER (PARTITION BY src),9) AS p FROM f")
def transition_prob_laplace(read):
    return rounded(s.normalised(s.completed(_c(read), read("events").select("event_type").distinct())), 9)


CLS = "u AS (SELECT *, (user_id % 2)::INT cls FROM events), t AS (SELECT cls, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) src, event_type dst FROM u), c AS (SELECT cls, src, dst, count(*) n FROM t WHERE src IS NOT NULL GROUP BY 1,2,3)"


def _by_class(read):
    e = read("events").withColumn("cls", (F.col("user_id") % 2).cast("int"))
    return s.transition_counts(e, "user_id", ORDER, "event_type", ["cls"])


@query(f"WITH {CLS} SELECT cls, src, dst, n, round(n/sum(n) OVER (PARTITION BY cls, src),9) AS p FROM c")
def transition_prob_by_class(read):
    return rounded(s.normalised(_by_class(read), ["cls"]), 9)


@query(f"""WITH {CLS}, p AS (SELECT cls, src, dst, n/sum(n) OVER (PARTITION BY cls, src) p FROM c), m AS (SELECT a.src, a.dst, a.p pos, b.p neg FROM p a JOIN p b ON a.cls=1 AND b.cls=0 AND a.src=b.src AND a.dst=b.dst),
q AS (SELECT user_id k, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) src, event_type dst FROM events)
SELECT k AS key, round(sum(ln(pos/neg)),7) AS score FROM q JOIN m ON q.src=m.src AND q.dst=m.dst GROUP BY 1""")
def markov_classify(read):
    p = s.normalised(_by_class(read), ["cls"])
    m = p.groupBy("src", "dst").agg(F.max(F.when(F.col("cls") == 1, F.col("p"))).alias("pos"), F.max(F.when(F.col("cls") == 0, F.col("p"))).alias("neg")).dropna()
    return rounded(s.log_odds(s.pairs(read("events"), "user_id", ORDER, "event_type"), m), 7)


@query("""WITH d AS (SELECT event_type src, lead(event_type) OVER w dst, epoch_us(lead(ts) OVER w)/1e6-epoch_us(ts)/1e6 dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT src, sum(dt) t FROM d WHERE dst IS NOT NULL GROUP BY 1)
SELECT d.src, dst, count(*) AS n, round(count(*)*86400.0/any_value(t),6) AS rate FROM d JOIN t ON d.src=t.src WHERE dst IS NOT NULL AND d.src<>dst GROUP BY 1,2""")
def ctmc_rates(read):
    return rounded(_rates(read))


def _rates(read):
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return s.rates(read("events"), "user_id", ORDER, "event_type", sec)


@query()
def ctmc_dwell(read):
    return rounded(s.dwell(_rates(read), 2.0))


@query("""WITH x AS (SELECT lag(event_type,2) OVER w a, lag(event_type) OVER w b, event_type c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT b||','||c gram FROM x WHERE b IS NOT NULL UNION ALL SELECT a||','||b||','||c FROM x WHERE a IS NOT NULL) SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def suffix_ngrams(read):
    return s.ngrams(read("events"), "user_id", ORDER, "event_type", 3)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS sequence FROM events GROUP BY 1")
def ordered_sequences(read):
    return s.ordered_sequences(read("events"), "user_id", ORDER, "event_type")


@query(f"WITH {T}, p AS (SELECT DISTINCT src, dst FROM t WHERE src IS NOT NULL) SELECT a.src||','||a.dst||','||b.dst AS seq FROM p a JOIN p b ON a.dst=b.src")
def sequence_join(read):
    p = _c(read).select(F.array("src", "dst").alias("seq"))
    return s.join_candidates(p).select(F.concat_ws(",", "seq").alias("seq"))


@query("""WITH d AS (SELECT user_id k, epoch_us(ts)/1e6 t, epoch_us(ts)/1e6-epoch_us(lag(ts) OVER w)/1e6 g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT k, t, sum(CASE WHEN g<=86400 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY t) c FROM d)
SELECT k, c::BIGINT AS c, count(*) AS n, round(max(t)-min(t),3) AS span FROM c GROUP BY 1,2""")
def positional_clusters(read):
    return rounded(s.positional_clusters(read("events"), "user_id", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 86400.0), 3)


@query("""SELECT CASE WHEN value>100 THEN 'high' ELSE 'low' END AS state, event_type AS obs, count(*) AS n FROM events GROUP BY 1,2""")
def hmm_counts(read):
    return read("events").groupBy(F.when(F.col("value") > 100, "high").otherwise("low").alias("state"), F.col("event_type").alias("obs")).agg(F.count("*").alias("n"))


@query()
def viterbi(read):
    e = read("events")
    seqs = e.groupBy(F.col("user_id").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("obs"))
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a row for each event type
    emit = {k: [(i + 1.0) / sum(range(1, len(kinds) + 1)), (len(kinds) - i) / sum(range(1, len(kinds) + 1))] for i, k in enumerate(kinds)}
    return s.viterbi(seqs, ["a", "b"], [0.5, 0.5], [[0.8, 0.2], [0.3, 0.7]], emit)
