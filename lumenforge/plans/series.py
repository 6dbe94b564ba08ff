from pyspark.sql import functions as F

from ..operators import series as s
from ..operators.contingency import rounded
from . import query

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(COLS) for b in COLS[i:]]
SER = "s AS (SELECT user_id k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value x FROM events)"


def _s(read):
    return s.indexed(read("events"), "user_id", ["ts", "event_id"], "value")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a},{b}),8) AS corr FROM lineitem" for a, b in PAIRS if a != b))
def pearson(read):
    return s.correlations(read("lineitem"), COLS).where("a <> b").select("a", "b", F.round("corr", 8).alias("corr"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a},{b}),4) AS covar FROM lineitem" for a, b in PAIRS))
def covariance_matrix(read):
    return s.correlations(read("lineitem"), COLS).select("a", "b", F.round("covar", 4).alias("covar"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1)/2.0 a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1)/2.0 b FROM lineitem) SELECT round(corr(a,b),8) AS rho FROM r")
def spearman(read):
    return rounded(s.spearman(read("lineitem"), "l_quantity", "l_extendedprice"), 8)


@query("""WITH d AS (SELECT o_orderkey i, o_custkey x, o_totalprice y FROM orders), p AS (SELECT sign(b.x-a.x) sx, sign(b.y-a.y) sy FROM d a JOIN d b ON a.i < b.i) SELECT round(sum(sx*sy)/sqrt(sum(abs(sx))::DOUBLE*sum(abs(sy))::DOUBLE),9) AS tau FROM p""")
def kendall(read):
    return rounded(s.kendall(read("orders"), "o_custkey", "o_totalprice"), 9)


@query(f"WITH {SER} SELECT a.k, round(median((b.x-a.x)/(b.i-a.i)),7) AS slope FROM s a JOIN s b ON a.k=b.k AND a.i<b.i GROUP BY 1")
def theil_sen(read):
    return rounded(s.theil_sen(_s(read)), 7)


@query(f"WITH {SER}, m AS (SELECT a.k, a.i, median((b.x-a.x)/(b.i-a.i)) m FROM s a JOIN s b ON a.k=b.k AND a.i<>b.i GROUP BY 1,2) SELECT k, round(median(m),7) AS slope FROM m GROUP BY 1")
def siegel(read):
    return rounded(s.siegel(_s(read)), 7)


@query("SELECT round(corr((l_returnflag='R')::INT, l_quantity),9) AS r FROM lineitem")
def point_biserial(read):
    return read("lineitem").agg(F.round(F.corr((F.col("l_returnflag") == "R").cast("int"), "l_quantity"), 9).alias("r"))


@query("""WITH g AS (SELECT count(*) n, avg(l_quantity) m, var_pop(l_quantity) v FROM lineitem GROUP BY l_returnflag), t AS (SELECT avg(l_quantity) gm FROM lineitem)
SELECT round(sum(n*(m-gm)^2)/(count(*)-1)/(sum(n*v)/(sum(n)-count(*))),7) AS f FROM g, t""")
def anova_f(read):
    return rounded(s.anova(read("lineitem"), "l_returnflag", "l_quantity"), 7)


@query("SELECT round(regr_slope(l_extendedprice,l_quantity),6) AS slope, round(regr_intercept(l_extendedprice,l_quantity),4) AS intercept, round(regr_r2(l_extendedprice,l_quantity),8) AS r2, count(*) AS n FROM lineitem")
def linear_fit(read):
    f = s.linear_fit(read("lineitem"), F.col("l_quantity"), F.col("l_extendedprice"))
    return f.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"), "n")


@query("WITH f AS (SELECT regr_slope(l_extendedprice,l_quantity) m, regr_intercept(l_extendedprice,l_quantity) b FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_extendedprice-(m*l_quantity+b),3) AS residual FROM lineitem, f")
def regression_residual(read):
    f = s.linear_fit(read("lineitem"), F.col("l_quantity"), F.col("l_extendedprice"))
    return read("lineitem").crossJoin(F.broadcast(f)).select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") - (F.col("slope") * F.col("l_quantity") + F.col("intercept")), 3).alias("residual"))


@query(f"WITH {SER}, d AS (SELECT k, i, x - lag(x) OVER (PARTITION BY k ORDER BY i) d FROM s) SELECT k, i, round(d,6) AS d FROM d WHERE d IS NOT NULL")
def difference(read):
    return rounded(s.difference(_s(read)).withColumn("i", F.col("i").cast("long")))


@query(f"WITH {SER} SELECT k, round(regr_slope(x,i),7) AS slope, round(regr_intercept(x,i),6) AS intercept FROM s GROUP BY k")
def trend_fit(read):
    return s.linear_fit(_s(read), F.col("i"), F.col("x"), ["k"]).select("k", F.round("slope", 7).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query(f"WITH {SER}, f AS (SELECT k, regr_slope(x,i) m, regr_intercept(x,i) b FROM s GROUP BY k) SELECT k, i, round(x-(m*i+b),5) AS x FROM s JOIN f USING (k)")
def detrend(read):
    return rounded(s.detrend(_s(read)).withColumn("i", F.col("i").cast("long")), 5)


@query(f"WITH {SER}, d AS (SELECT k, x - lag(x) OVER (PARTITION BY k ORDER BY i) d FROM s) SELECT k, round(stddev_pop(d),6) AS noise FROM d GROUP BY k")
def diff_noise(read):
    return s.difference(_s(read)).groupBy("k").agg(F.round(F.stddev_pop("d"), 6).alias("noise"))


@query(f"WITH {SER}, d AS (SELECT k, x - avg(x) OVER w e, count(*) OVER w n FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT k, round(sqrt(avg(e*e)),6) AS noise FROM d WHERE n=5 GROUP BY k")
def ma_rmse_noise(read):
    return rounded(s.moving_average_noise(_s(read), 5))


@query(f"""WITH {SER}, t AS (SELECT k, i, x, CASE WHEN count(*) OVER w = 7 THEN avg(x) OVER w END t FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
c AS (SELECT k, i%7 p, avg(x-t) c FROM t WHERE t IS NOT NULL GROUP BY 1,2) SELECT t.k, i, round(t,5) AS trend, round(c,5) AS season, round(x-t-c,5) AS residue FROM t JOIN c ON t.k=c.k AND i%7=p""")
def seasonal_components(read):
    return rounded(s.seasonal(_s(read), 7).withColumn("i", F.col("i").cast("long")), 5)


@query(f"""WITH {SER}, m AS (SELECT k, avg(x) m FROM s GROUP BY k), c AS (SELECT s.k, i, x-m c FROM s JOIN m USING (k)), v AS (SELECT k, sum(c*c) v FROM c GROUP BY k)
SELECT a.k, (a.i-b.i)::INT AS lag, round(sum(a.c*b.c)/any_value(v),8) AS acf FROM c a JOIN c b ON a.k=b.k AND a.i-b.i BETWEEN 1 AND 5 JOIN v ON v.k=a.k GROUP BY 1,2""")
def autocorr(read):
    return rounded(s.autocorrelation(_s(read), 5), 8)


@query(f"WITH {SER}, d AS (SELECT k, i, count(*) OVER w n, avg(x) OVER w m, stddev_pop(x) OVER w d FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT k, i, round(m,5) AS mean, round(d,5) AS sd FROM d WHERE n=10")
def sliding_stats(read):
    return rounded(s.sliding(_s(read), 10).withColumn("i", F.col("i").cast("long")), 5)


@query(f"WITH {SER}, t AS (SELECT floor(x/50)::INT::VARCHAR s0, lead(floor(x/50)::INT::VARCHAR,1) OVER w s1, lead(floor(x/50)::INT::VARCHAR,2) OVER w s2 FROM s WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT s0||':'||s1||':'||s2 AS tuple, count(*) AS n, round(count(*)*1.0/sum(count(*)) OVER (),9) AS freq FROM t WHERE s2 IS NOT NULL GROUP BY 1")
def time_delay_embedding(read):
    return rounded(s.embedding(_s(read), 3, F.floor(F.col("x") / 50).cast("int").cast("string")), 9)


@query("SELECT event_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1,2")
def event_time_hist(read):
    return read("events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT date_trunc('hour', ts) h, avg(value) x FROM events WHERE event_type='click' OR event_type=(SELECT min(event_type) FROM events) GROUP BY 1), b AS (SELECT date_trunc('hour', ts) h, avg(value) y FROM events WHERE event_type=(SELECT max(event_type) FROM events) GROUP BY 1)
SELECT h AS hour, round(x,6) AS x, round(y,6) AS y FROM a FULL JOIN b USING (h)""")
def time_align(read):
    e = read("events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type", "value")
    m = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    e = e.crossJoin(F.broadcast(m))
    a = e.where("event_type = lo or event_type = 'click'").groupBy("hour").agg(F.round(F.avg("value"), 6).alias("x"))
    b = e.where("event_type = hi").groupBy("hour").agg(F.round(F.avg("value"), 6).alias("y"))
    return a.join(b, "hour", "full")


@query("WITH m AS (SELECT avg(value) m, stddev_pop(value) s FROM events) SELECT event_id, round((value-m)/s,6) AS z FROM events, m WHERE abs((value-m)/s) > 3")
def zscore_outliers(read):
    e = read("events")
    m = e.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return e.crossJoin(F.broadcast(m)).where(F.abs(z) > 3).select("event_id", F.round(z, 6).alias("z"))
