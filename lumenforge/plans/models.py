from pyspark.sql import functions as F

from ..operators import encoding as e
from ..operators import models as m
from ..operators.contingency import rounded
from . import query

KEY = ["l_orderkey", "l_linenumber"]


def pos():
    return F.col("l_returnflag") == "R"


def _l(read):
    return read("lineitem")


@query("SELECT o_orderkey, (o_orderstatus='F')::INT AS \"o_orderstatus_F\", (o_orderstatus='O')::INT AS \"o_orderstatus_O\", (o_orderstatus='P')::INT AS \"o_orderstatus_P\" FROM orders")
def dummy_vars(read):
    return e.dummies(read("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query("SELECT DISTINCT c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment)-1)::INT AS code FROM customer")
def label_encode(read):
    return e.label_codes(read("customer"), "c_mktsegment")


@query("SELECT s_suppkey, round((s_acctbal-(SELECT min(s_acctbal) FROM supplier))/((SELECT max(s_acctbal) FROM supplier)-(SELECT min(s_acctbal) FROM supplier)),8) AS s_acctbal FROM supplier")
def minmax_scale(read):
    return rounded(e.minmax(read("supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal"]), 8)


@query("WITH r AS (SELECT avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer) SELECT c_custkey, round((c_acctbal-m)/s,7) AS c_acctbal FROM customer, r")
def zscale(read):
    return rounded(e.zscale(read("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), 7)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity*2+l_discount*10,6) AS y0, round(l_quantity*0.5-l_discount,6) AS y1 FROM lineitem")
def linear_map(read):
    return rounded(_l(read).select(*KEY, *e.linear_map(["l_quantity", "l_discount"], [[2.0, 10.0], [0.5, -1.0]])))


@query("SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity-10)^2+(l_tax*100-3)^2),6) AS euclidean, round(abs(l_quantity-10)+abs(l_tax*100-3),6) AS manhattan, round(greatest(abs(l_quantity-10),abs(l_tax*100-3)),6) AS chebyshev, round(1-(l_quantity*10+l_tax*100*3)/sqrt((l_quantity^2+(l_tax*100)^2)*109),6) AS cosine FROM lineitem")
def vector_distances(read):
    return rounded(_l(read).select(*KEY, *e.distances([F.col("l_quantity"), F.col("l_tax") * 100], [F.lit(10.0), F.lit(3.0)])))


@query(r"SELECT c_custkey, upper(c_mktsegment) AS up, substr(c_name,1,8) AS head, length(c_name) AS n, replace(c_name,'#','-') AS dashed, regexp_extract(c_name,'[0-9]+') AS digits, lpad(c_custkey::VARCHAR,8,'0') AS padded FROM customer")
def string_ops(read):
    c = F.col("c_name")
    return read("customer").select("c_custkey", F.upper("c_mktsegment").alias("up"), F.substring(c, 1, 8).alias("head"), F.length(c).alias("n"), F.replace(c, F.lit("#"), F.lit("-")).alias("dashed"), F.regexp_extract(c, "[0-9]+", 0).alias("digits"), F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"))


@query("SELECT event_id, round(least(greatest(value,10),200),6) AS limited, CASE WHEN value<50 THEN 1.0 WHEN value<150 THEN 2.0 ELSE 3.0 END::DOUBLE AS stepped, json_extract_string(props,'$.k') AS k FROM events")
def range_and_step(read):
    x = F.col("value")
    return read("events").select("event_id", F.round(F.least(F.greatest(x, F.lit(10.0)), F.lit(200.0)), 6).alias("limited"), e.step(x, [(50.0, 1.0), (150.0, 2.0), (1e18, 3.0)]).alias("stepped"), F.get_json_object("props", "$.k").alias("k"))


@query("WITH p AS (SELECT s_suppkey k, (s_suppkey%90)::DOUBLE la, (s_suppkey%180)::DOUBLE lo FROM supplier) SELECT k, round(2*6371*asin(sqrt(sin((radians(40.0)-radians(la))/2)^2+cos(radians(la))*cos(radians(40.0))*sin((radians(-74.0)-radians(lo))/2)^2)),5) AS km FROM p")
def geo_distance(read):
    la, lo = (F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 180).cast("double")
    return read("supplier").select(F.col("s_suppkey").alias("k"), F.round(e.haversine(la, lo, F.lit(40.0), F.lit(-74.0)), 5).alias("km"))


@query()
def hash_encode(read):
    return read("orders").select("o_orderkey", *e.hash_vector(F.col("o_orderpriority"), 8))


def nb_features():
    return {"status": F.col("l_linestatus"), "line": F.col("l_linenumber"), "quantity": F.least(F.floor(F.col("l_quantity") / 10), F.lit(4))}


NB = "u AS (SELECT rid, l_orderkey, l_linenumber, l_returnflag cls, unnest(['status','line','quantity']) feature, unnest([l_linestatus, l_linenumber::VARCHAR, (least(floor(l_quantity/10),4))::INT::VARCHAR]) v FROM (SELECT *, row_number() OVER () rid FROM lineitem)), d AS (SELECT feature, v, cls, count(*) n FROM u GROUP BY 1,2,3)"


@query(f"WITH {NB} SELECT feature, v AS value, cls, n FROM d")
def nb_distribution(read):
    return m.nb_distribution(_l(read), "l_returnflag", nb_features())


@query(f"""WITH {NB}, t AS (SELECT feature, cls, sum(n) t FROM d GROUP BY 1,2), k AS (SELECT feature, count(DISTINCT v) k FROM d GROUP BY 1), p AS (SELECT cls, ln(t/sum(t) OVER ()) p FROM t WHERE feature='status'),
s AS (SELECT u.rid, any_value(u.l_orderkey) l_orderkey, any_value(u.l_linenumber) l_linenumber, t.cls, sum(ln((coalesce(d.n,0)+1)/(t+k))) s FROM u JOIN t ON u.feature=t.feature JOIN k ON u.feature=k.feature LEFT JOIN d ON d.feature=u.feature AND d.v=u.v AND d.cls=t.cls GROUP BY u.rid, t.cls),
q AS (SELECT rid, l_orderkey, l_linenumber, s.cls, round(s+p,9) score FROM s JOIN p ON s.cls=p.cls), r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, cls DESC) rn FROM q)
SELECT l_orderkey, l_linenumber, cls FROM r WHERE rn=1""")
def nb_predict(read):
    d = m.nb_distribution(_l(read), "l_returnflag", nb_features())
    return m.nb_predict(_l(read), KEY, d, nb_features()).drop("score")


@query("SELECT l_returnflag AS cls, count(*) AS n, round(avg(l_extendedprice),4) AS mean, round(stddev_samp(l_extendedprice),4) AS sd FROM lineitem GROUP BY 1")
def nb_gaussian(read):
    return rounded(_l(read).groupBy(F.col("l_returnflag").alias("cls")).agg(F.count("*").alias("n"), F.avg("l_extendedprice").alias("mean"), F.stddev_samp("l_extendedprice").alias("sd")), 4)


def _bits(p):
    return f"(-({p}*log2({p})+(1-{p})*log2(1-{p})))"


@query(f"""WITH x AS (SELECT pt AS point, (SELECT count(*) FROM lineitem)::DOUBLE a, (SELECT count_if(l_returnflag='R') FROM lineitem)::DOUBLE ap, (SELECT count(*) FROM lineitem WHERE l_quantity<=pt) n, (SELECT count_if(l_returnflag='R') FROM lineitem WHERE l_quantity<=pt) h FROM (SELECT unnest([10.0,20.0,30.0,40.0])::DOUBLE pt))
SELECT point, n, round({_bits('(ap/a)')}-(n/a*{_bits('(h/n)')}+(a-n)/a*{_bits('((ap-h)/(a-n))')}),9) AS gain FROM x""")
def tree_split_level(read):
    return rounded(m.best_split(_l(read), "l_quantity", pos(), [10.0, 20.0, 30.0, 40.0]), 9)


@query()
def tree_grow(read):
    got = m.grow_tree(_l(read), pos(), {"l_quantity": [10, 20, 30, 40], "l_discount": [0.02, 0.05, 0.08]}, 2)
    return read.spark.createDataFrame([(g["path"], g["population"], round(g["prob"], 9)) for g in got], "path string, population long, prob double")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity<=20 THEN CASE WHEN l_discount<=0.05 THEN 'A' ELSE 'N' END ELSE 'R' END AS predicted FROM lineitem")
def tree_predict(read):
    return _l(read).select(*KEY, F.when(F.col("l_quantity") <= 20, F.when(F.col("l_discount") <= 0.05, "A").otherwise("N")).otherwise("R").alias("predicted"))


@query("WITH a AS (SELECT l_quantity q, l_discount*100 d, (l_quantity-10)^2+(l_discount*100-2)^2 a, (l_quantity-40)^2+(l_discount*100-8)^2 b FROM lineitem) SELECT (a>b)::INT AS k, count(*) AS n, round(avg(q),6) AS q, round(avg(d),6) AS d, round(sum(least(a,b)),3) AS sse FROM a GROUP BY 1")
def kmeans_step(read):
    r = m.kmeans_step(_l(read).select(F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d")), ["q", "d"], [[10.0, 2.0], [40.0, 8.0]])
    return r.select("k", "n", F.round("q", 6).alias("q"), F.round("d", 6).alias("d"), F.round("sse", 3).alias("sse"))


@query("WITH s AS (SELECT l_quantity/50 x, l_discount*10 y, (l_returnflag='R')::INT - 1/(1+exp(-(0.1+0.2*(l_quantity/50)-0.3*(l_discount*10)))) e FROM lineitem) SELECT round(avg(e),8) AS g0, round(avg(e*x),8) AS g1, round(avg(e*y),8) AS g2 FROM s")
def logistic_gradient(read):
    d = _l(read).select((F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), pos().cast("int").alias("t"))
    return rounded(m.logistic_gradient(d, ["x", "y"], F.col("t"), [0.1, 0.2, -0.3]), 8)


@query("""WITH g AS (SELECT count_if(o_orderstatus<>'F')::DOUBLE n0, count_if(o_orderstatus='F')::DOUBLE n1, avg(o_totalprice) FILTER (o_orderstatus<>'F') m0, avg(o_totalprice) FILTER (o_orderstatus='F') m1, var_pop(o_totalprice) FILTER (o_orderstatus<>'F') v0, var_pop(o_totalprice) FILTER (o_orderstatus='F') v1 FROM orders)
SELECT round((n0*v0+n1*v1)/(n0+n1),0) AS pooled_variance, round(ln(n0/n1),9) AS log_odds FROM g""")
def fisher(read):
    f = m.fisher(read("orders"), "o_totalprice", F.col("o_orderstatus") == "F")
    return f.select(F.round("pooled_variance", 0).alias("pooled_variance"), F.round("log_odds", 9).alias("log_odds"))


@query("SELECT l_orderkey, l_linenumber, ((l_quantity>25)::INT+(l_discount>0.05)::INT+(l_tax>0.04)::INT)*2>3 AS vote, (l_quantity/50*5>(1-l_quantity/50)*2)::INT AS decision FROM lineitem")
def ensemble_vote(read):
    p = F.col("l_quantity") / 50
    return _l(read).select(*KEY, m.majority([F.col("l_quantity") > 25, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04]).alias("vote"), m.cost_decision(p, 2.0, 5.0).alias("decision"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def cluster_label_size(read):
    return read("embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query()
def kmeans_fit(read):
    d = _l(read).select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"))
    got = m.kmeans(d, ["q", "d"], [[0.2, 0.2], [0.8, 0.8], [0.2, 0.8]])
    return read.spark.createDataFrame([(i, round(a, 6), round(b, 6)) for i, (a, b) in enumerate(got)], "k int, q double, d double")


@query()
def principal_components(read):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = read("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return PCA(k=3, inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", *(F.round(F.abs(vector_to_array("p")[i]), 5).alias(f"p{i}") for i in range(3)))
