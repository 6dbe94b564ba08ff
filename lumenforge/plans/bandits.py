from pyspark.sql import functions as F

from ..operators import bandits as b
from ..operators import batch_choice as bc
from ..operators import learners, sampling
from ..operators import similarity as s
from ..operators.contingency import rounded
from . import query

A = "a AS (SELECT event_type arm, count(*)::DOUBLE n, avg(value) m, var_pop(value) v FROM events GROUP BY 1), t AS (SELECT sum(n) N FROM a)"


def _a(read):
    return b.arm_stats(read("events").withColumnRenamed("event_type", "arm"), "arm", "value")


@query(f"WITH {A} SELECT arm, round(m/500+sqrt(2*ln(t.N)/a.n),7) AS score FROM (SELECT arm, n, m, v FROM a) a, t")
def ucb1_scores(read):
    return rounded(b.ucb1(_a(read), 500.0).select("arm", "score"), 7)


@query(f"WITH {A} SELECT arm, round(m/500+sqrt(ln(t.N)/a.n*least(0.25,v/250000+sqrt(2*ln(t.N)/a.n))),7) AS score FROM a, t")
def ucb1_tuned(read):
    return rounded(b.ucb1(_a(read), 500.0, True).select("arm", "score"), 7)


@query(f"WITH {A} SELECT arm, round(exp(m/100)/sum(exp(m/100)) OVER (),7) AS p FROM a")
def softmax_probs(read):
    return rounded(b.softmax(_a(read), 100.0).select("arm", "p"), 7)


@query(f"WITH {A} SELECT arm, round(m+1.96*sqrt(v/n),5) AS upper, round(m-1.96*sqrt(v/n),5) AS lower FROM a")
def interval_estimate(read):
    half = 1.96 * F.sqrt(F.col("var") / F.col("n"))
    return rounded(_a(read).select("arm", (F.col("mean") + half).alias("upper"), (F.col("mean") - half).alias("lower")), 5)


@query("WITH a AS (SELECT o_custkey%50 g, o_orderpriority arm, count(*) n FROM orders WHERE o_totalprice > 450000 GROUP BY 1,2), x AS (SELECT DISTINCT o_custkey%50 g FROM orders), y AS (SELECT DISTINCT o_orderpriority arm FROM orders) SELECT x.g, y.arm FROM x CROSS JOIN y LEFT JOIN a ON a.g=x.g AND a.arm=y.arm WHERE n IS NULL")
def untried_first(read):
    o = read("orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderpriority").alias("arm"), "o_totalprice")
    tried = o.where("o_totalprice > 450000").select("g", "arm").distinct()
    return o.select("g").distinct().crossJoin(F.broadcast(o.select("arm").distinct())).join(tried, ["g", "arm"], "left_anti")


@query("WITH s AS (SELECT user_id g, event_type arm, count(*) n, sum(value) s FROM events WHERE hour(ts)<12 GROUP BY 1,2), r AS (SELECT user_id g, event_type arm, count(*) n, sum(value) s FROM events WHERE hour(ts)>=12 GROUP BY 1,2) SELECT coalesce(s.g,r.g) AS g, coalesce(s.arm,r.arm) AS arm, coalesce(s.n,0)+coalesce(r.n,0) AS n, round((coalesce(s.s,0)+coalesce(r.s,0))/(coalesce(s.n,0)+coalesce(r.n,0)),6) AS mean FROM s FULL JOIN r ON s.g=r.g AND s.arm=r.arm")
def reward_update(read):
    e = read("events").select(F.col("user_id").alias("g"), F.col("event_type").alias("arm"), "value", "ts")
    state = lambda d: d.groupBy("g", "arm").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    both = state(e.where("hour(ts) < 12")).unionAll(state(e.where("hour(ts) >= 12")))
    return both.groupBy("g", "arm").agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"))


@query()
def thompson(read):
    u, v = b.uniform(1, F.col("arm")), b.uniform(2, F.col("arm"))
    z = F.sqrt(-2 * F.log(u)) * F.cos(6.283185307179586 * v)
    return rounded(_a(read).select("arm", (F.col("mean") + z * F.sqrt(F.col("var") / F.col("n"))).alias("draw")))


@query()
def random_greedy(read):
    """Explores with probability 0.1, by a hash of the group."""
    e = read("events").select(F.col("user_id").alias("g"), F.col("event_type").alias("arm"), "value")
    best = e.groupBy("g", "arm").agg(F.avg("value").alias("m")).groupBy("g").agg(F.max(F.struct("m", "arm")).alias("x"), F.array_sort(F.collect_set("arm")).alias("arms"))
    pick = F.element_at("arms", (F.floor(b.uniform(4, F.col("g")) * F.size("arms")) + 1).cast("int"))
    return best.select("g", F.when(b.uniform(3, F.col("g")) < 0.1, pick).otherwise(F.col("x.arm")).alias("arm"))


@query()
def exp3(read):
    st = _a(read)
    w = F.exp(0.1 * F.col("mean") / 500 * F.col("n") / 1000)
    k = st.agg(F.count("*").alias("K"), F.sum(w).alias("W"))
    return rounded(st.crossJoin(F.broadcast(k)).select("arm", (0.9 * w / F.col("W") + 0.1 / F.col("K")).alias("p")))


@query()
def bagging(read):
    return b.bag(read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1.0)


@query()
def under_sample(read):
    d = read("labels").select("doc_id", "toxic")
    return b.sample_classes(d, "toxic", "doc_id")


@query()
def smote(read):
    from .similarity import PC, _parts

    p = _parts(read)
    least = p.groupBy("p_type").agg(F.count("*").alias("n")).orderBy("n", "p_type").limit(1)
    rare = p.join(F.broadcast(least), "p_type", "left_semi")
    return rounded(b.smote(s.neighbours_in_order(rare, "p_partkey", ["p_brand"], "p_retailprice", 3), rare, "p_partkey", PC))


@query()
def monte_carlo(read):
    v = b.monte_carlo(read.spark, 40_000, lambda rng, n: (rng.random(n) ** 2 + rng.random(n) ** 2 <= 1) * 4.0)
    return v.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("pi"))


def _tour(rng=None):
    import numpy as np

    at = np.random.default_rng(5).random((12, 2))
    return at, lambda x: float(np.sqrt(((at[x] - at[np.roll(x, 1)]) ** 2).sum(1)).sum())


def _swap(rng, x):
    y = x.copy()
    i, j = rng.integers(0, len(x), 2)
    y[[i, j]] = y[[j, i]]
    return y


@query()
def annealing(read):
    return rounded(b.search(read.spark, _tour()[1], _swap, lambda rng: rng.permutation(12), 8, 300))


@query()
def random_search(read):
    return rounded(b.search(read.spark, _tour()[1], _swap, lambda rng: rng.permutation(12), 8, 300, "random"))


@query()
def genetic(read):
    return rounded(b.genetic(read.spark, _tour()[1], 12, 12, 20, 20))


IT = "i AS (SELECT user_id grp, event_type item, count(*) n, avg(value) m FROM events GROUP BY 1,2), x AS (SELECT u grp, e item, coalesce(n,0)::BIGINT n, coalesce(m,0) m FROM (SELECT DISTINCT user_id u FROM events) CROSS JOIN (SELECT DISTINCT event_type e FROM events) LEFT JOIN i ON i.grp=u AND i.item=e)"


def _items(read):
    e = read("events")
    have = e.groupBy(F.col("user_id").alias("grp"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    kinds = e.select(F.col("event_type").alias("item")).distinct()  # a row for each event type
    every = e.select(F.col("user_id").alias("grp")).distinct().crossJoin(F.broadcast(kinds))
    return every.join(have, ["grp", "item"], "left").select("grp", "item", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"))


@query(f"WITH {IT}, t AS (SELECT *, sum(n) OVER (PARTITION BY grp) t FROM x), r AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY (n=0)::INT DESC, round(m/500+sqrt(2*ln(greatest(t,1))/greatest(n,1)),9) DESC, item) rank FROM t) SELECT grp, item, rank::INT AS rank FROM r WHERE rank<=2")
def batch_ucb(read):
    return bc.deterministic(_items(read), 2, 500.0)


@query()
def batch_greedy(read):
    return bc.greedy(_items(read), 2, 3)


@query()
def batch_softmax(read):
    return bc.soft_max(_items(read), 2, 20.0)


@query(f"WITH {IT}, r AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY (n=0)::INT DESC, round(m,9) DESC, item) rank FROM x) SELECT grp, item, rank::INT AS rank FROM r WHERE rank<=2")
def batch_exploit(read):
    """After its rounds of exploration: the best."""
    return bc.first_explore(_items(read), 2, 1000, learners.explore_rounds(5))


def _learner(name, options):
    def f(read):
        e = read("events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("seq"), F.col("event_type").alias("arm"), F.col("value").alias("reward"))
        arms = [r[0] for r in e.select("arm").distinct().collect()]  # a row for each event type
        state = e.select("grp").distinct().withColumn("state", F.lit(None).cast("string"))
        return learners.batch_round(state, e, arms, name, 2, reward_scale=500.0, **options).select("grp", "actions")

    return f


for _n in learners.LEARNERS:
    query(name=f"learner_{_n}")(_learner(_n, {}))


@query()
def sample_percent(read):
    return sampling.percent(read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0.1)


@query()
def sample_weighted(read):
    return sampling.weighted(read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 100)


@query()
def block_shuffle(read):
    return sampling.block_shuffled(read("events").select("event_id", "value"), "event_id", 100).select("event_id", "place.block", "place.u")


@query()
def bootstrap_extremes(read):
    return sampling.bootstrap_extremes(read("orders"), "o_orderkey", "o_totalprice", 1000, 20)


@query()
def sample_in_batches(read):
    return sampling.batches(read("orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)
