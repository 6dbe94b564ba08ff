from pyspark.sql import functions as F

from ..operators import information as i
from ..operators.contingency import measures, rounded
from ..operators.describe import histogram
from . import query
from .describe import HIST


@query(f"WITH {HIST} SELECT round(sum(-(c*1.0/n)*ln(c*1.0/n)),6) AS entropy FROM h")
def entropy_num(read):
    return histogram(read("events"), "value", 20).agg(F.round(F.sum(-F.col("freq") * F.log("freq")), 6).alias("entropy"))


@query("WITH c AS (SELECT count(*)*1.0/(SELECT count(*) FROM events) p FROM events GROUP BY event_type) SELECT round(sum(-p*ln(p)),9) AS entropy FROM c")
def entropy_cat(read):
    return i.entropy_of(read("events").groupBy("event_type").agg(F.count("*").alias("n"))).select(F.round("h", 9).alias("entropy"))


BINS = "least(floor(l_quantity/10),4)"


def quantity_bin():
    return F.least(F.floor(F.col("l_quantity") / 10), F.lit(4))


@query(f"""WITH p AS (SELECT {BINS} b, count(*)*1.0/sum(count(*)) OVER () p FROM lineitem WHERE l_returnflag='R' GROUP BY 1), q AS (SELECT {BINS} b, count(*)*1.0/sum(count(*)) OVER () q FROM lineitem WHERE l_returnflag<>'R' GROUP BY 1)
SELECT round(sum(p*ln(p/q)),9) AS kl FROM p JOIN q USING (b)""")
def kl_divergence(read):
    g = read("lineitem").groupBy(quantity_bin().alias("b")).agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count_if(F.col("l_returnflag") != "R").alias("y"))
    t = g.agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
    p, q = F.col("x") / F.col("all_x"), F.col("y") / F.col("all_y")
    return g.crossJoin(F.broadcast(t)).agg(F.round(F.sum(p * F.log(p / q)), 9).alias("kl"))


MI = "WITH s AS (SELECT {a} a, {b} b FROM lineitem), c AS (SELECT a, b, count(*)::DOUBLE n FROM s GROUP BY 1,2), m AS (SELECT n, sum(n) OVER (PARTITION BY a) r, sum(n) OVER (PARTITION BY b) c, sum(n) OVER () t FROM c) SELECT round(sum(n/t*ln(n*t/(r*c))),9) AS mi FROM m"


def _mi(df, a, b):
    return measures(df.select(a.alias("x"), b.alias("y")), "x", "y").select(F.round("mutual_info", 9).alias("mi"))


@query(MI.format(a="l_returnflag", b="l_linenumber"))
def mi_cat_cat(read):
    return _mi(read("lineitem"), F.col("l_returnflag"), F.col("l_linenumber"))


@query(MI.format(a=BINS, b="l_returnflag"))
def mi_num_cat(read):
    return _mi(read("lineitem"), quantity_bin(), F.col("l_returnflag"))


@query(MI.format(a=BINS, b="least(floor(l_extendedprice/20000),4)"))
def mi_num_num(read):
    return _mi(read("lineitem"), quantity_bin(), F.least(F.floor(F.col("l_extendedprice") / 20000), F.lit(4)))


@query(f"""WITH c AS (SELECT l_linestatus z, l_returnflag a, {BINS} b, count(*)::DOUBLE n FROM lineitem GROUP BY 1,2,3),
m AS (SELECT n, sum(n) OVER (PARTITION BY z,a) r, sum(n) OVER (PARTITION BY z,b) c, sum(n) OVER (PARTITION BY z) t, sum(n) OVER () g FROM c) SELECT round(sum(n/g*ln(n*t/(r*c))),9) AS mi FROM m""")
def cond_mi(read):
    c = i.joint(read("lineitem"), {"z": F.col("l_linestatus"), "a": F.col("l_returnflag"), "b": quantity_bin()})
    s = lambda *k: c.groupBy(*k).agg(F.sum("n").alias("_" + "".join(k)))
    x = c.join(s("z", "a"), ["z", "a"]).join(s("z", "b"), ["z", "b"]).join(s("z"), "z").crossJoin(F.broadcast(c.agg(F.sum("n").alias("g"))))
    n = F.col("n")
    return x.agg(F.round(F.sum(n / F.col("g") * F.log(n * F.col("_z") / (F.col("_za") * F.col("_zb")))), 9).alias("mi"))


def _table(read):
    f = {"discount": F.round(F.col("l_discount") * 100).cast("int"), "line": F.col("l_linenumber"), "quantity": quantity_bin(), "status": F.col("l_linestatus")}
    return i.information_table(read("lineitem"), f, F.col("l_returnflag"))


SEL = {"discount": "round(l_discount*100)::INT", "line": "l_linenumber", "quantity": BINS + "::INT", "status": "l_linestatus"}


def _h(cols):
    g = ", ".join(SEL.get(c, c) for c in cols)
    return f"(SELECT ln(sum(n))-sum(n*ln(n))/sum(n) FROM (SELECT count(*)::DOUBLE n FROM lineitem GROUP BY {g}))"


def _mim_sql():
    return " UNION ALL ".join(f"SELECT '{k}' AS feature, round({_h([k])}+{_h(['l_returnflag'])}-{_h([k, 'l_returnflag'])},9) AS score" for k in SEL)


@query(_mim_sql())
def mim_scores(read):
    return _table(read).where("b is null").select(F.col("a").alias("feature"), F.round("mi", 9).alias("score"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_h([a])}+{_h([b])}-{_h([a, b])},9) AS redundancy, round({_h([a, b])}+{_h(['l_returnflag'])}-{_h([a, b, 'l_returnflag'])},9) AS joint_relevance" for a, b in (("discount", "line"), ("discount", "quantity"), ("discount", "status"), ("line", "quantity"), ("line", "status"), ("quantity", "status"))))
def pair_information(read):
    t = _table(read)
    one = t.where("b is null").select(F.col("a").alias("k"), F.col("h").alias("hk"))
    p = t.where("b is not null").join(F.broadcast(one.withColumnsRenamed({"k": "a", "hk": "ha"})), "a").join(F.broadcast(one.withColumnsRenamed({"k": "b", "hk": "hb"})), "b")
    return p.select("a", "b", F.round(F.col("ha") + F.col("hb") - F.col("h"), 9).alias("redundancy"), F.round("mi", 9).alias("joint_relevance"))


def _scores(algorithm):
    def f(read):
        got = i.feature_scores(_table(read), algorithm)
        return read.spark.createDataFrame([(k, f_, round(s, 9)) for k, (f_, s) in enumerate(got)], "place int, feature string, score double")

    return f


for _a in ("mifs", "jmi", "disr", "mrmr", "cmim", "icap"):
    query(name=f"{_a}_scores")(_scores(_a))

SPLIT = """WITH g AS (SELECT (l_quantity>25)::INT s, count(*)::DOUBLE n, count_if(l_returnflag='R')::DOUBLE p FROM lineitem GROUP BY 1), x AS (SELECT *, sum(n) OVER () t, sum(p) OVER () tp FROM g),
y AS (SELECT n/t w, p/n p, p/tp a, (n-p)/(t-tp) b, tp/t r FROM x)
SELECT round(sum(w*-(p*log2(p)+(1-p)*log2(1-p))),9) AS entropy, round(sum(w*(1-p*p-(1-p)*(1-p))),9) AS gini, round(sqrt(sum((sqrt(a)-sqrt(b))^2)),9) AS hellinger,
round(sum(w*-(a/(a+b)*log2(a/(a+b))+b/(a+b)*log2(b/(a+b)))),9) AS class_conf, round(any_value(-(r*log2(r)+(1-r)*log2(1-r)))-sum(w*-(p*log2(p)+(1-p)*log2(1-p))),9) AS gain,
round((any_value(-(r*log2(r)+(1-r)*log2(1-r)))-sum(w*-(p*log2(p)+(1-p)*log2(1-p))))/sum(-w*log2(w)),9) AS gain_ratio FROM y"""


@query(SPLIT)
def split_statistics(read):
    return rounded(i.split_stats(read("lineitem"), (F.col("l_quantity") > 25).cast("int"), F.col("l_returnflag") == "R"), 9)
