from pyspark.sql import functions as F

from ..operators import clusters as k
from ..operators import contingency as c
from ..operators import learning as m
from ..operators import models as md
from ..operators import similarity as s
from ..operators import text as t
from ..operators.contingency import rounded
from . import query
from .models import KEY, _l, pos
from .similarity import EM, PC, PS, Q, _near, _parts, _vec
from .sql import uniform

COLS = ["l_quantity", "l_discount", "l_tax"]


def _accuracy(kind, **options):
    def f(read):
        d = _l(read).select(*COLS, pos().cast("double").alias("y"))
        got = m.fit(d, kind, COLS, F.col("y"), **options).transform(m.assembled(d, COLS))
        return got.groupBy("prediction").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("share"))

    return f


for _k in m.CLASSIFIERS:
    query(name=f"classify_{_k}")(_accuracy(_k, **({"layers": [3, 4, 2]} if _k == "network" else {})))


def _error(kind):
    def f(read):
        d = _l(read)
        got = m.fit(d, kind, COLS, F.col("l_extendedprice")).transform(m.assembled(d, COLS))
        return rounded(c.regression_metrics(got, F.col("l_extendedprice"), F.col("prediction")), 4)

    return f


for _k in m.REGRESSORS:
    query(name=f"regress_{_k}")(_error(_k))


@query()
def parameter_search(read):
    d = read("customer").withColumn("y", (F.col("c_mktsegment") == "BUILDING").cast("double"))
    got = m.search(d, "c_custkey", "tree", ["c_acctbal", "c_nationkey"], F.col("y"), [{"maxDepth": 2}, {"maxDepth": 4}])
    return read.spark.createDataFrame([(o["maxDepth"], round(a, 6)) for o, a in got], "depth int, accuracy double")


@query()
def logistic_fit(read):
    d = _l(read).select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), pos().cast("int").alias("y"))
    got = m.logistic_fit(d, ["q", "d"], F.col("y"), rounds=15)
    return read.spark.createDataFrame([(i, round(v, 8)) for i, v in enumerate(got)], "i int, coefficient double")


@query()
def kmeans_knee(read):
    d = read("part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"))
    fits = m.kmeans_starts(d, "p_partkey", ["a", "b"], [2, 3, 4, 5], 2, 4)
    best = m.knee(fits)
    return read.spark.createDataFrame([(k, round(e, 6), k == best) for k, e, _ in fits], "k int, sse double, knee boolean")


@query()
def gaussian_mixture(read):
    from pyspark.ml.clustering import GaussianMixture

    d = m.assembled(read("part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b")), ["a", "b"])
    model = GaussianMixture(k=2, seed=1, maxIter=10).fit(d)
    return read.spark.createDataFrame([(i, round(w, 4)) for i, w in enumerate(model.weights)], "i int, weight double")


@query("WITH c AS (SELECT p_brand cluster, count(*) n FROM part GROUP BY 1), w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b, sum(n) OVER () t, lag(n) OVER (ORDER BY n DESC, cluster) p FROM c), x AS (SELECT *, max((coalesce(p*1.0/n,0)>=2)::INT) OVER (ORDER BY n DESC, cluster ROWS UNBOUNDED PRECEDING) k FROM w) SELECT cluster, n, b/t < 0.7 AND k=0 AS large FROM x")
def cluster_sizes(read):
    return m.size_labels(read("part").groupBy(F.col("p_brand").alias("cluster")).agg(F.count("*").alias("n")))


@query()
def dbscan(read):
    p = _parts(read).select(F.col("p_partkey").alias("key"), F.array(*PC).alias("v"), F.col("p_brand").alias("group"))
    return m.dbscan_places(p, 0.03, 4, len(PC))


BP = "pr AS (SELECT a.k src, b.k dst, sqrt(((a.x-b.x)^2+(a.y-b.y)^2)/2) d FROM p a JOIN p b ON a.b=b.b AND a.k<>b.k)"


@query(f"WITH {PS}, {BP} SELECT src, round(d,8) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) r FROM pr) WHERE r=4")
def k_distances(read):
    return rounded(m.k_distances(_near(read, 4, "p_brand", every=True), 4), 8)


@query()
def hopkins(read):
    return rounded(m.hopkins(_parts(read), "p_partkey", PC))


@query()
def edge_clusters(read):
    p = _parts(read).select(F.col("p_partkey").alias("key"), F.array(*PC).alias("v"), F.col("p_brand").alias("group"))
    return m.near_clusters(p, 0.05, 0.3)


def _score(x):
    import numpy as np

    return 1 / (1 + np.exp(-(x[:, 0] / 25 - x[:, 1] / 1500)))


@query()
def local_explanations(read):
    p = read("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return rounded(m.explain(p, "p_partkey", ["p_size", "p_retailprice"], _score, {"p_size": 10.0, "p_retailprice": 300.0}), 6)


@query("SELECT p_partkey, v AS value, round(v/25.0-p_retailprice/1500,7) AS prediction FROM part, (SELECT unnest([1,25,50])::INT v)")
def conditional_expectation(read):
    return rounded(m.conditional_expectation(read("part"), "p_partkey", "p_size", [1, 25, 50], F.col("p_size") / 25.0 - F.col("p_retailprice") / 1500), 7)


@query(f"WITH {PS}, {Q} SELECT src, round(avg((gb='PROMO')::INT),6) AS accuracy FROM nn WHERE rn<=5 GROUP BY 1")
def local_accuracy(read):
    hits = read("part").select(F.col("p_partkey").alias("key"), (F.col("p_type") == "PROMO").alias("right"))
    return rounded(m.local_accuracy(_near(read, 5), hits))


@query("""WITH e AS (SELECT DISTINCT o_custkey c, l_suppkey s FROM orders JOIN lineitem ON o_orderkey=l_orderkey), n AS (SELECT s, c_acctbal x FROM e JOIN customer ON c=c_custkey UNION ALL SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT s FROM e))
SELECT s AS node, round(avg(x),5) AS x FROM n GROUP BY 1""")
def message_pass(read):
    """Suppliers take the mean of their customers' balances and their own."""
    e = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") + 1_000_000_000).alias("a"), F.col("l_suppkey").alias("b")).distinct()
    n = read("customer").select((F.col("c_custkey") + 1_000_000_000).alias("node"), F.col("c_acctbal").alias("x")).unionAll(read("supplier").select("s_suppkey", "s_acctbal"))
    return m.message_pass(n, e).where("node < 1000000000").join(e.select(F.col("b").alias("node")).distinct(), "node", "left_semi").select("node", F.round("x", 5).alias("x"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p > 1.5 THEN 'R' WHEN 3-p > 1.5 THEN 'N' END AS vote FROM (SELECT *, (CASE WHEN l_quantity>25 THEN 1.5 ELSE 0 END + CASE WHEN l_discount>0.05 THEN 1 ELSE 0 END + CASE WHEN l_tax>0.04 THEN 0.5 ELSE 0 END) p FROM lineitem)")
def weighted_vote(read):
    v = lambda x: F.when(x, "R").otherwise("N")
    return _l(read).select(*KEY, m.weighted_vote([(v(F.col("l_quantity") > 25), 1.5), (v(F.col("l_discount") > 0.05), 1.0), (v(F.col("l_tax") > 0.04), 0.5)], 1.0001).alias("vote"))


@query(f"WITH {EM}, q AS (SELECT label l, count(*)*1.0/sum(count(*)) OVER () p FROM embeddings GROUP BY 1) SELECT src, dst, cls, round(p,8) AS p, round(d,6) AS dist FROM nn JOIN q ON cls=l WHERE rn<=7")
def class_weighted_neighbours(read):
    e = read("embeddings")
    n = e.agg(F.count("*").alias("all_n"))
    share = e.groupBy("label").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("label", (F.col("k") / F.col("all_n")).alias("p"))
    post = e.join(F.broadcast(share), "label").select(F.col("vec_id").alias("key"), F.col("label").alias("cls"), "p")
    return s.class_weighted(_vec(read), post).select("src", "dst", "cls", F.round("p", 8).alias("p"), F.round("dist", 6).alias("dist"))


@query(f"WITH {EM} SELECT src, round(median(cls),6) AS prediction FROM nn WHERE rn<=7 GROUP BY 1")
def knn_median(read):
    return rounded(s.regress(_vec(read), "cls", "median"))


@query(f"WITH {EM} SELECT src, round(coalesce(regr_intercept(cls, d), avg(cls)),4) AS prediction FROM nn WHERE rn<=7 GROUP BY 1")
def knn_linear(read):
    return rounded(s.regress(_vec(read), "cls", "linear"), 4)


@query("WITH t AS (SELECT item_id k, unnest(list_filter(regexp_split_to_array(lower(text),'[^a-z]+'), lambda x: x<>'')) term FROM benchmark), n AS (SELECT k, term, count(*)::DOUBLE n FROM t GROUP BY 1,2), m AS (SELECT k, sqrt(sum(n*n)) m FROM n GROUP BY 1) SELECT a.k AS k1, b.k AS k2, round(sum(a.n*b.n)/any_value(x.m*y.m),7) AS cosine FROM n a JOIN n b ON a.term=b.term JOIN m x ON x.k=a.k JOIN m y ON y.k=b.k WHERE a.k%20=0 GROUP BY 1,2")
def term_cosine(read):
    n = t.counts(read("benchmark").withColumnRenamed("item_id", "k"), t.tokens(F.col("text")), "k")
    return rounded(s.term_cosine(n.where("k % 20 = 0"), n), 7)


@query("WITH s AS (SELECT l_extendedprice y, l_quantity*1500 p FROM lineitem) SELECT round(1-avg((y-p)^2)/var_pop(y),6) AS r2, round(avg(abs(y-p)),3) AS mae, round(avg((y-p)^2),0) AS mse FROM s")
def regression_metrics(read):
    r = c.regression_metrics(_l(read), F.col("l_extendedprice"), F.col("l_quantity") * 1500)
    return r.select(F.round("r2", 6).alias("r2"), F.round("mae", 3).alias("mae"), F.round("mse", 0).alias("mse"))


@query("WITH s AS (SELECT l_returnflag='R' a, least(1-1e-15,greatest(1e-15,l_quantity/50)) q, l_quantity/50>0.5 p FROM lineitem), k AS (SELECT count_if(a AND p) tp, count_if(NOT a AND p) fp, count_if(NOT a AND NOT p) tn, count_if(a AND NOT p) fn, avg(CASE WHEN a THEN -ln(q) ELSE -ln(1-q) END) h FROM s) SELECT round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy, round(tp/(tp+fp),6) AS precision, round(tp/(tp+fn),6) AS recall, round(2*(tp/(tp+fp))*(tp/(tp+fn))/(tp/(tp+fp)+tp/(tp+fn)),6) AS f1, round(h,6) AS cross_entropy FROM k")
def class_metrics(read):
    return rounded(c.class_metrics(_l(read), pos(), F.col("l_quantity") / 50))


@query("SELECT o_orderstatus AS actual, CASE WHEN o_totalprice>300000 THEN 'F' WHEN o_totalprice>150000 THEN 'O' ELSE 'P' END AS predicted, count(*) AS n FROM orders GROUP BY 1,2")
def confusion_table(read):
    o = read("orders").withColumn("g", F.when(F.col("o_totalprice") > 300000, "F").when(F.col("o_totalprice") > 150000, "O").otherwise("P"))
    return c.confusion_table(o, "o_orderstatus", "g")


@query("SELECT 100*tp//(tp+fn) AS recall, 100*tp//(tp+fp) AS precision, 100*(tp+tn)//(tp+fp+tn+fn) AS accuracy FROM (SELECT count_if(a AND p) tp, count_if(NOT a AND p) fp, count_if(NOT a AND NOT p) tn, count_if(a AND NOT p) fn FROM (SELECT l_returnflag='R' a, l_quantity>25 p FROM lineitem))")
def integer_percents(read):
    return c.integer_percents(c.confusion(_l(read), pos(), F.col("l_quantity") > 25))


@query("WITH b AS (SELECT count_if(a AND x)/count_if(a) b1, count_if(a AND x)/count_if(x) b2, count_if(x AND y)/count_if(x) q, count_if(y)/count(*) p FROM (SELECT l_linestatus='F' a, l_quantity>20 x, l_returnflag='R' y FROM lineitem)) SELECT round(b1,6) AS b1, round(b2,6) AS b2, round(b1/b2*(b2+q-1)/p,6) AS lift_min, round((1-b1+q*b1/b2)/p,6) AS lift_max FROM b")
def proxy_lift(read):
    return rounded(c.proxy_lift(_l(read), F.col("l_linestatus") == "F", F.col("l_quantity") > 20, pos()))


@query("SELECT round(corr(l_quantity,l_extendedprice),8) AS r FROM lineitem")
def stats_correlation(read):
    return rounded(c.stats_correlation(_l(read), "l_quantity", "l_extendedprice"), 8)


@query("WITH c AS (SELECT p_type v, p_size%3 c, count(*) n FROM part WHERE p_type<>'PROMO' OR p_size%3<>0 GROUP BY 1,2), f AS (SELECT v, c, coalesce(n,1) n FROM (SELECT DISTINCT v FROM c) CROSS JOIN (SELECT DISTINCT c FROM c) LEFT JOIN c USING (v,c)) SELECT v AS value, c AS cls, n, round(n/sum(n) OVER (PARTITION BY c),9) AS p FROM f")
def smoothed_conditionals(read):
    p = read("part").withColumn("c", F.col("p_size") % 3).where("p_type <> 'PROMO' or c <> 0")
    return rounded(c.smoothed_conditionals(p, "p_type", "c"), 9)


@query()
def loo_encode_noise(read):
    o = read("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return c.leave_one_out(o, "o_orderpriority", "y", noise=0.3, key="o_orderkey").select("o_orderkey", F.round("code", 9).alias("code"))


_MIXED = "p AS (SELECT p_partkey key, p_brand g, p_type t, p_size::DOUBLE s, p_retailprice r FROM part)"
_GAP = "(((p.s-c.s)/50)^2+((p.r-c.r)/1000)^2+(p.t<>c.t)::INT)/3"


def _mixed(read):
    return read("part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("g"), F.col("p_type").alias("t"), F.col("p_size").cast("double").alias("s"), F.col("p_retailprice").alias("r"))


def _mixed_sql(rounds: int) -> str:
    out = f"WITH {_MIXED}, c0 AS MATERIALIZED (SELECT g, (row_number() OVER (PARTITION BY g ORDER BY {uniform(1, 'key')})-1) k, s, r, t, 0.0::DOUBLE m FROM p QUALIFY k<3)"
    for i in range(rounds):
        out += f""", a{i} AS MATERIALIZED (SELECT p.g, p.s, p.r, p.t, c.k, {_GAP} d FROM p JOIN c{i} c ON c.g=p.g QUALIFY row_number() OVER (PARTITION BY p.key ORDER BY d, c.k)=1), t{i} AS (SELECT g, k, t FROM a{i} GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY g, k ORDER BY count(*) DESC, t)=1), m{i} AS (SELECT g, k, count(*) n, avg(s) s, avg(r) r, avg(d) e FROM a{i} GROUP BY 1,2),
n{i} AS (SELECT c.g, c.k, coalesce(m.n,0) n, coalesce(m.s,c.s) s, coalesce(m.r,c.r) r, coalesce(t.t,c.t) t, coalesce(m.e,0) e, c.s s0, c.r r0, c.t t0 FROM c{i} c LEFT JOIN m{i} m ON m.g=c.g AND m.k=c.k LEFT JOIN t{i} t ON t.g=c.g AND t.k=c.k), c{i + 1} AS MATERIALIZED (SELECT g, k, n, s, r, t, e, sqrt((((s-s0)/50)^2+((r-r0)/1000)^2+(t<>t0)::INT)/3) m FROM n{i})"""
    return out


@query(_mixed_sql(1) + " SELECT g, k::INT AS k, n, round(s,6) AS s, round(r,6) AS r, t, round(e,8) AS error, round(m,8) AS movement, max(m) OVER (PARTITION BY g) > 1e-9 AS active FROM c1")
def kmeans_groups_step(read):
    """One round of clusters of sizes, prices and types within each brand."""
    d = _mixed(read)
    got = k.cluster_round(d, "g", ["s", "r"], ["t"], k.first_centres(d, "g", "key", ["s", "r", "t"], 3), {"s": 50.0, "r": 1000.0})
    return got.select("g", "k", "n", F.round("s", 6).alias("s"), F.round("r", 6).alias("r"), "t", F.round("error", 8).alias("error"), F.round("movement", 8).alias("movement"), "active")


@query(_mixed_sql(4) + " SELECT g, k::INT AS k, n, round(s,6) AS s, round(r,6) AS r, t FROM c4")
def kmeans_groups(read):
    """Up to four rounds; groups that have settled are not read again."""
    d = _mixed(read)
    got = k.cluster_groups(d, "g", ["s", "r"], ["t"], k.first_centres(d, "g", "key", ["s", "r", "t"], 3), 4, scale={"s": 50.0, "r": 1000.0})
    return got.select("g", "k", "n", F.round("s", 6).alias("s"), F.round("r", 6).alias("r"), "t")


def _starts_sql(n: int) -> str:
    out = f"WITH p AS MATERIALIZED (SELECT p_partkey k, p_size/50.0::DOUBLE a, p_retailprice/2000 b FROM part), s0 AS (SELECT 0 i, a, b FROM p ORDER BY {uniform(1, 'k')}, k LIMIT 1)"
    for i in range(1, n):
        seen = " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(i))
        out += f", d{i} AS (SELECT p.k, p.a, p.b, min((p.a-s.a)^2+(p.b-s.b)^2) d FROM p, ({seen}) s GROUP BY ALL), s{i} AS (SELECT {i} i, a, b FROM d{i} WHERE d>0 ORDER BY ln({uniform(1 + i, 'k')})/d DESC, k DESC LIMIT 1)"
    return out + " SELECT i, round(a,6) AS a, round(b,6) AS b FROM (" + " UNION ALL ".join(f"SELECT * FROM s{j}" for j in range(n)) + ")"


@query(_starts_sql(4))
def kmeans_spread_starts(read):
    d = read("part").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"))
    got = k.spread_starts(d, "p_partkey", ["a", "b"], 4)
    return read.spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(got)], "i int, a double, b double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 3*(100-p)+p < 5*p+(100-p) THEN 'P' ELSE 'N' END AS arbitrated, CASE WHEN p > 300//8 THEN 'P' ELSE 'N' END AS by_threshold FROM (SELECT *, floor(l_quantity*2)::INT p FROM lineitem)")
def cost_arbitration(read):
    p = F.floor(F.col("l_quantity") * 2).cast("int")
    return _l(read).select(*KEY, md.arbitrate(p, 100 - p, 5, 3).alias("arbitrated"), md.cost_threshold(p, 5, 3).alias("by_threshold"))
