from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import normality as n
from ..operators import outliers as o
from ..operators import per_series as ps
from ..operators import series as s
from ..operators.contingency import rounded
from ..sources.shared import stored
from . import query
from .series import SER, _s
from .similarity import PS, _near
from .twosample import EC, V, first


@query("""WITH m AS (SELECT avg(value) m FROM events), k AS (SELECT count(*)::DOUBLE n, avg((value-m)^2) v, avg((value-m)^3) c, avg((value-m)^4) q FROM events, m), x AS (SELECT n, c/pow(v,1.5) s, q/(v*v) b FROM k),
y AS (SELECT *, s*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) b2, (b-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) kx, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) ks FROM x),
z AS (SELECT *, sqrt(2*(b2-1))-1 w2, 6+8/ks*(2/ks+sqrt(1+4/(ks*ks))) a FROM y),
u AS (SELECT *, sqrt(2/(w2-1)) al, 1+kx*sqrt(2/(a-4)) d FROM z),
r AS (SELECT 1/sqrt(ln(sqrt(w2)))*ln(y/al+sqrt((y/al)^2+1)) sz, (1-2/(9*a)-sign(d)*pow((1-2/a)/abs(d),1/3.0::DOUBLE))/sqrt(2/(9*a)) kz FROM u)
SELECT round(sz,5) AS skew_z, round(kz,5) AS kurtosis_z, round(sz*sz+kz*kz,3) AS k2 FROM r""")
def dagostino(read):
    r = n.dagostino(read("events"), "value")
    return r.select(F.round("skew_z", 5).alias("skew_z"), F.round("kurtosis_z", 5).alias("kurtosis_z"), F.round("k2", 3).alias("k2"))


@query("""WITH m AS (SELECT avg(value) m, count(*)::DOUBLE n FROM events), x AS (SELECT row_number() OVER (ORDER BY value) i, value v FROM events), c AS (SELECT i, least(1-1e-12,greatest(1e-12,1-exp(-v/m))) f, n FROM x, m)
SELECT round(-any_value(n)-sum((2*i-1)*ln(f)+(2*(n-i)+1)*ln(1-f))/any_value(n),4) AS a2 FROM c""")
def anderson_expon(read):
    return rounded(n.anderson(read("events"), "value", "expon"), 4)


@query()
def anderson_logistic(read):
    return rounded(n.anderson(read("events"), "value", "logistic"), 4)


@query()
def anderson_gumbel(read):
    a = n.anderson(read("events"), "value", "gumbel_r").select(F.lit("gumbel_r").alias("law"), "a2")
    return rounded(a.unionByName(n.anderson(read("events"), "value", "gumbel_l").select(F.lit("gumbel_l").alias("law"), "a2")), 4)


@query()
def anderson_two(read):
    return rounded(n.anderson_two(read("lineitem"), V, first()), 6)


@query()
def fligner(read):
    return rounded(n.fligner(read("lineitem"), V, "l_returnflag"), 6)


@query()
def epps_singleton(read):
    return rounded(n.epps_singleton(read("lineitem"), V, first()), 6)


@query(f"""WITH r AS (SELECT l_returnflag='R' g, rank() OVER (ORDER BY {V}) + (count(*) OVER (PARTITION BY {V})-1)/2.0 r, row_number() OVER (PARTITION BY l_returnflag='R' ORDER BY {V})::DOUBLE j, count(*) OVER (PARTITION BY l_returnflag='R')::DOUBLE ni, count(*) OVER ()::DOUBLE n FROM lineitem)
SELECT round(sum(ln(ni/(j-0.5)-1)*ln(n/(r-0.5)-1))/any_value(n),6) AS zc FROM r""")
def zhang_c(read):
    return rounded(n.zhang_c(read("lineitem"), V, first()), 6)


@query("""WITH v AS (SELECT DISTINCT value x FROM events), d AS (SELECT x, lead(x) OVER (ORDER BY x) y FROM v), c AS (SELECT count(*)::DOUBLE n FROM v)
SELECT round(sum(ln(y-x))/(any_value(n)-1)+ln(any_value(n))-1/(2*any_value(n))-1/(12*any_value(n)^2)+0.5772156649015329,6) AS entropy FROM d, c WHERE y IS NOT NULL""")
def one_space_entropy(read):
    return rounded(n.one_space_entropy(read("events"), "value"), 6)


@query("""WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY 1,2), s AS (SELECT n, sum(n) OVER (PARTITION BY a)*sum(n) OVER (PARTITION BY b)/sum(n) OVER () e FROM c)
SELECT round(sum((n-e)^2/e),6) AS chi_square, 8 AS degrees FROM s""")
def chi_square_test(read):
    return rounded(n.chi_square_test(read("orders"), "o_orderstatus", "o_orderpriority")).select("chi_square", "degrees")


@query()
def p_values(read):
    c = n.chi_square_test(read("orders"), "o_orderstatus", "o_orderpriority").select(F.lit("chi_square").alias("test"), "p")
    r = n.correlation_test(read("lineitem"), "l_quantity", "l_extendedprice").select(F.lit("pearson").alias("test"), "p")
    a = n.anova_test(read("lineitem"), "l_returnflag", "l_quantity").select(F.lit("anova").alias("test"), "p")
    return rounded(c.unionByName(r).unionByName(a), 9)


@query("""WITH c AS (SELECT l_quantity v, count(*) n FROM lineitem GROUP BY 1) SELECT min(v) AS mode, any_value(n) AS n FROM c WHERE n=(SELECT max(n) FROM c)""")
def mode(read):
    c = read("lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return c.agg(F.max(F.struct("n", (-F.col("l_quantity")).alias("v"))).alias("x")).select((-F.col("x.v")).alias("mode"), F.col("x.n").alias("n"))


@query(f"""WITH {SER}, t AS (SELECT k, i, x, l_x FROM (SELECT k, i, x, lag(x,1) OVER (PARTITION BY k ORDER BY i) l_x FROM s)), d AS (SELECT k, i, x, x-l_x y FROM t WHERE l_x IS NOT NULL), m AS (SELECT k, avg(x) mx, avg(y) my FROM d GROUP BY k), c AS (SELECT d.k, i, x-mx x, y-my y FROM d JOIN m USING (k)), v AS (SELECT k, sqrt(sum(x*x)*sum(y*y)) v FROM c GROUP BY k)
SELECT a.k, (a.i-b.i)::INT AS lag, round(sum(a.x*b.y)/any_value(v),7) AS ccf FROM c a JOIN c b ON a.k=b.k AND a.i-b.i BETWEEN 0 AND 3 JOIN v ON v.k=a.k GROUP BY 1,2""")
def crosscorr(read):
    """Of a series and its first differences."""
    w = Window.partitionBy("k").orderBy("i")
    d = _s(read).withColumn("y", F.col("x") - F.lag("x").over(w)).where("y is not null")
    return rounded(s.cross_correlation(d, 3), 7)


@query(f"WITH {SER}, l AS (SELECT k, i, x a, lead(x,1) OVER w b, lead(x,2) OVER w c, lead(x,3) OVER w y FROM s WINDOW w AS (PARTITION BY k ORDER BY i)) SELECT k, i, a AS x0, b AS x1, c AS x2, y FROM l WHERE y IS NOT NULL")
def labelled_subseq(read):
    return s.labelled(_s(read), 3).withColumn("i", F.col("i").cast("long"))


@query(f"WITH {SER} SELECT k, i, count(*) OVER w AS n, round(avg(x) OVER w,9) AS mean, round(stddev_samp(x) OVER w,9) AS sd FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)")
def running_stats(read):
    return rounded(s.running_stats(_s(read)).withColumn("i", F.col("i").cast("long")), 9)


@query()
def partial_autocorr(read):
    return rounded(ps.per_series(_s(read), lambda x: ps.partial_autocorrelation(x, 5), "lag long, pacf double"), 8)


@query()
def hurst_exponent(read):
    return rounded(ps.per_series(_s(read), lambda x: [(ps.hurst(x),)], "hurst double"))


@query()
def approx_entropy(read):
    return rounded(ps.per_series(_s(read), lambda x: [(ps.approximate_entropy(x),)], "entropy double"))


@query()
def discord(read):
    return rounded(ps.per_series(_s(read), lambda x: ps.discord(x, 5), "at long, dist double"))


@query(f"""WITH {SER}, n AS (SELECT k, count(*) n FROM s GROUP BY k), f AS (SELECT n.k, unnest(range(0, n//2+1)) freq, n FROM n)
SELECT f.k, freq, round(sum(x*cos(2*pi()*freq*i/n)),5) AS re, round(sum(-x*sin(2*pi()*freq*i/n)),5) AS im FROM f JOIN s ON s.k=f.k GROUP BY 1,2""".replace("round(sum(x*cos", "round(0.0+sum(x*cos"))
def fourier(read):
    f = ps.per_series(_s(read), ps.spectrum, "freq long, re double, im double")
    return f.select("k", "freq", F.round(F.col("re") + 0.0, 5).alias("re"), F.round(F.col("im") + 0.0, 5).alias("im"))


@query()
def adf_test(read):
    return rounded(ps.per_series(_s(read), ps.adf, "t double, c1 double, c5 double, c10 double, stationary boolean"))


@query()
def kpss_test(read):
    return rounded(ps.per_series(_s(read), ps.kpss, "stat double, p double, lags long"))


@query()
def shapiro(read):
    return rounded(ps.per_series(_s(read), ps.shapiro_wilk, "w double, p double"))


@query()
def spirit(read):
    e = read("events").withColumn("hour", F.hour("ts").cast("double"))
    return rounded(ps.principal_stream(e, "user_id", "event_id", ["value", "hour"]))


@query()
def forecast(read):
    return rounded(ps.per_series(_s(read), lambda x: ps.holt_winters(x, 7, 3), "ahead long, x double"))


@query(f"""WITH {PS}, pr AS (SELECT a.k src, b.k dst, sqrt(((a.x-b.x)^2+(a.y-b.y)^2)/2) d FROM p a JOIN p b ON a.b=b.b AND a.k<>b.k), nn AS (SELECT src, dst, d FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) rn FROM pr) WHERE rn<=5), kd AS (SELECT src, max(d) kd FROM nn GROUP BY 1),
lr AS (SELECT nn.src, 1/greatest(avg(greatest(d, kd)),1e-12) l FROM nn JOIN kd ON kd.src=nn.dst GROUP BY 1), m AS (SELECT nn.src, avg(l) m FROM nn JOIN lr ON lr.src=nn.dst GROUP BY 1) SELECT m.src, round(m/l,6) AS lof FROM m JOIN lr ON lr.src=m.src""")
def local_outliers(read):
    """Within brands."""
    return rounded(o.local_outlier_factor(stored(_near(read, 5, "p_brand", every=True), "near"), 5))


@query("""WITH m AS (SELECT avg(p_size) a, avg(p_retailprice) b, var_samp(p_size) va, var_samp(p_retailprice) vb, covar_samp(p_size,p_retailprice) c FROM part)
SELECT p_partkey, round(sqrt(((p_size-a)^2*vb-2*(p_size-a)*(p_retailprice-b)*c+(p_retailprice-b)^2*va)/(va*vb-c*c)),6) AS distance FROM part, m""")
def mahalanobis(read):
    return o.mahalanobis(read("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]).select("p_partkey", F.round("distance", 6).alias("distance"))


@query()
def robust_mahalanobis(read):
    return o.mahalanobis(read("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], robust=0.75).select("p_partkey", F.round("distance", 6).alias("distance"))


@query()
def isolation_forest(read):
    return o.isolation_forest(read("part"), "p_partkey", ["p_size", "p_retailprice"])
