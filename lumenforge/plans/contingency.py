from pyspark.sql import functions as F

from ..operators import contingency as c
from . import query

CT = "ct AS (SELECT l_returnflag a, l_linestatus b, count(*) n FROM lineitem GROUP BY 1,2), s AS (SELECT a, b, n::DOUBLE n, (sum(n) OVER (PARTITION BY a))::DOUBLE r, (sum(n) OVER (PARTITION BY b))::DOUBLE c, (sum(n) OVER ())::DOUBLE t FROM ct), pb AS (SELECT sum(n)/any_value(t) p FROM s GROUP BY b)"


def _m(read):
    return c.measures(read("lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1,2")
def crosstab(read):
    return c.crosstab(read("lineitem"), "l_returnflag", "l_linestatus")


Q = "(sum(n*n/(r*c))-1)/(least(count(DISTINCT a),count(DISTINCT b))-1)"


@query(f"WITH {CT} SELECT round({Q},9) AS cramer_index, round(sqrt({Q}),9) AS cramer_v FROM s")
def cramer_index(read):
    return c.rounded(_m(read).select("cramer_index", "cramer_v"), 9)


@query(f"WITH {CT} SELECT round((sum(n*n/(t*r))-(SELECT sum(p*p) FROM pb))/(1-(SELECT sum(p*p) FROM pb)),9) AS concentration FROM s")
def concentration_coeff(read):
    return c.rounded(_m(read).select("concentration"), 9)


@query(f"WITH {CT} SELECT round(sum(n/t*ln(n*t/(r*c)))/(SELECT sum(-p*ln(p)) FROM pb),9) AS uncertainty FROM s")
def uncertainty_coeff(read):
    return c.rounded(_m(read).select("uncertainty"), 9)


@query(f"WITH {CT} SELECT round((sum(n*n/(r*c))-1)*any_value(t),6) AS chi_square FROM s")
def chi_square(read):
    return c.rounded(_m(read).select("chi_square"), 6)


def pos():
    return F.col("l_returnflag") == "R"


CS = "g AS (SELECT l_shipmode_ AS value, count_if(l_returnflag='R') pos, count_if(l_returnflag<>'R') neg FROM (SELECT *, l_linenumber AS l_shipmode_ FROM lineitem) GROUP BY 1), s AS (SELECT value, pos, neg, sum(pos) OVER () POSI, sum(neg) OVER () NEGA FROM g)"


@query(f"WITH {CS}, q AS (SELECT value, pos/POSI p, neg/NEGA n FROM s) SELECT value, round(p/(1-p)/(n/(1-n)),9) AS odds, round(p-n,9) AS diff, round(p*(1-n),9) AS min_risk, round(p*ln(p/n),9) AS kl FROM q")
def class_affinity(read):
    return c.rounded(c.affinity(read("lineitem"), "l_linenumber", pos()), 9)


@query(f"WITH {CS} SELECT value, pos*100//(pos+neg) AS code FROM s")
def supervised_ratio(read):
    return c.supervised_ratio(read("lineitem"), "l_linenumber", pos())


@query(f"WITH {CS} SELECT value, trunc(1000*ln((pos/POSI)/(greatest(neg,1)/NEGA)))::INT AS code FROM s")
def weight_of_evidence(read):
    return c.weight_of_evidence(read("lineitem"), "l_linenumber", pos(), 1000)


@query("""WITH y AS (SELECT o_orderkey, o_orderpriority v, (o_orderstatus='F')::INT y FROM orders), s AS (SELECT v, count(*) n, sum(y) s FROM y GROUP BY 1)
SELECT o_orderkey, round((s-y)/(n-1+10.0),9) AS code FROM y JOIN s USING (v)""")
def loo_encode_no_noise(read):
    o = read("orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return c.leave_one_out(o, "o_orderpriority", "y").select("o_orderkey", F.round("code", 9).alias("code"))


@query("""WITH s AS (SELECT count_if(l_quantity>30 AND l_discount<=0.05) n, count_if(l_quantity>30 AND l_discount<=0.05 AND l_returnflag='R') h, count(*) t FROM lineitem), q AS (SELECT *, h/n p FROM s)
SELECT 'r1' AS rule, n, round(p,6) AS confidence, round(1+p*log2(p)+(1-p)*log2(1-p),6) AS entropy_confidence, round(n/t,6) AS support FROM q""")
def rule_confidence(read):
    return c.rounded(c.rule(read("lineitem"), F.expr("l_quantity > 30 and l_discount <= 0.05"), pos(), "r1"))


CONF = "SELECT count_if(a AND p) tp, count_if(NOT a AND p) fp, count_if(NOT a AND NOT p) tn, count_if(a AND NOT p) fn FROM (SELECT l_returnflag='R' a, l_quantity>25 p FROM lineitem)"


@query(f"SELECT *, round(tp/(tp+fn),6) AS recall, round(tp/(tp+fp),6) AS precision, round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy FROM ({CONF})")
def confusion_counts(read):
    return c.rounded(c.confusion(read("lineitem"), pos(), F.col("l_quantity") > 25))


CAL = "cal AS (SELECT least(floor(p*10),9)::INT bin, count(*) n, avg(p) conf, avg((((p>0.5)=(y=1)))::INT) acc FROM (SELECT l_quantity/50.0 p, (l_returnflag='R')::INT y FROM lineitem) GROUP BY 1)"


def _cal(read):
    return c.calibration(read("lineitem"), F.col("l_quantity") / 50.0, pos().cast("int"))


@query(f"WITH {CAL} SELECT bin, n, round(conf,6) AS confidence, round(acc,6) AS accuracy FROM cal")
def calibration_bins(read):
    return c.rounded(_cal(read))


@query(f"WITH {CAL} SELECT round(sum(n*abs(conf-acc))/sum(n),6) AS ece, round(max(abs(conf-acc)),6) AS mce FROM cal")
def ece_mce(read):
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    return c.rounded(_cal(read).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce")))


@query(f"WITH {CAL}, g AS (SELECT sum(n*acc)/sum(n) a FROM cal) SELECT round(avg(abs(acc-a)),6) AS sharpness FROM cal, g")
def sharpness(read):
    k = _cal(read)
    g = k.agg((F.sum(F.col("n") * F.col("accuracy")) / F.sum("n")).alias("a"))
    return c.rounded(k.crossJoin(F.broadcast(g)).agg(F.avg(F.abs(F.col("accuracy") - F.col("a"))).alias("sharpness")))


@query("""WITH t AS (SELECT count_if(c_mktsegment='BUILDING' AND o_orderstatus='F')/count_if(c_mktsegment='BUILDING') pb, count_if(o_orderstatus='F')/count(*) p, count_if(c_mktsegment<>'BUILDING' AND o_orderstatus='F')/count_if(c_mktsegment<>'BUILDING') pn FROM orders JOIN customer ON o_custkey=c_custkey)
SELECT round(pb/p,6) AS ext_lift, round(pb/pn,6) AS contr_lift, round(pb/(1-pb),6) AS odds, round((pb/(1-pb))/(pn/(1-pn)),6) AS odds_lift, round(pb-pn,6) AS parity FROM t""")
def bias_metrics(read):
    j = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    a, y = F.col("c_mktsegment") == "BUILDING", F.col("o_orderstatus") == "F"
    t = j.agg((F.count_if(a & y) / F.count_if(a)).alias("pb"), (F.count_if(y) / F.count("*")).alias("p"), (F.count_if(~a & y) / F.count_if(~a)).alias("pn"))
    pb, p, pn = F.col("pb"), F.col("p"), F.col("pn")
    return c.rounded(t.select((pb / p).alias("ext_lift"), (pb / pn).alias("contr_lift"), (pb / (1 - pb)).alias("odds"), ((pb / (1 - pb)) / (pn / (1 - pn))).alias("odds_lift"), (pb - pn).alias("parity")))


@query("""WITH s AS (SELECT abs(l_extendedprice - l_quantity*1500) s FROM lineitem), o AS (SELECT s, row_number() OVER (ORDER BY s) rn, count(*) OVER () n FROM s)
SELECT round(s,4) AS bound FROM o WHERE rn = floor(n*0.9)+1""")
def conformal_bound(read):
    return c.rounded(c.conformal_bound(read("lineitem"), F.abs(F.col("l_extendedprice") - F.col("l_quantity") * 1500), 0.9), 4)


@query("SELECT round(sum(CASE WHEN (l_quantity>25)<>(l_returnflag='R') THEN l_tax+1 ELSE 0 END)/count(*),6) AS error FROM lineitem")
def adaboost_error(read):
    wrong = (F.col("l_quantity") > 25) != pos()
    return c.rounded(read("lineitem").agg((F.sum(F.when(wrong, F.col("l_tax") + 1).otherwise(0.0)) / F.count("*")).alias("error")))


@query("""WITH e AS (SELECT sum(((l_quantity>25)<>(l_returnflag='R'))::INT)/count(*) e FROM lineitem), a AS (SELECT CASE WHEN e<0.5 THEN 0.5*ln((1-e)/e) END a FROM e)
SELECT l_orderkey, l_linenumber, round(CASE WHEN a IS NULL THEN 1.0 WHEN (l_quantity>25)<>(l_returnflag='R') THEN exp(a) ELSE exp(-a) END,6) AS boost FROM lineitem, a""")
def adaboost_update(read):
    wrong = (F.col("l_quantity") > 25) != pos()
    e = read("lineitem").agg(F.avg(wrong.cast("int")).alias("e")).select(F.when(F.col("e") < 0.5, 0.5 * F.log((1 - F.col("e")) / F.col("e"))).alias("a"))
    a = F.col("a")
    return read("lineitem").crossJoin(F.broadcast(e)).select("l_orderkey", "l_linenumber", F.round(F.when(a.isNull(), 1.0).when(wrong, F.exp(a)).otherwise(F.exp(-a)), 6).alias("boost"))
