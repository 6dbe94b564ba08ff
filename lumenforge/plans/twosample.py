from pyspark.sql import functions as F

from ..operators import twosample as t
from ..operators.contingency import rounded
from . import query
V = "l_extendedprice"
EC = f"v AS (SELECT {V} x, count_if(l_returnflag='R')::DOUBLE a, count_if(l_returnflag<>'R')::DOUBLE b FROM lineitem GROUP BY 1), e AS (SELECT x, a, b, sum(a) OVER (ORDER BY x) ca, sum(b) OVER (ORDER BY x) cb, sum(a) OVER () na, sum(b) OVER () nb, lead(x) OVER (ORDER BY x) nx FROM v)"
RK = f"r AS (SELECT l_returnflag g, rank() OVER (ORDER BY {V}) + (count(*) OVER (PARTITION BY {V})-1)/2.0 r, count(*) OVER () n FROM lineitem), tie AS (SELECT sum(k::DOUBLE^3-k) t FROM (SELECT count(*) k FROM lineitem GROUP BY {V}))"


def first():
    return F.col("l_returnflag") == "R"


def _l(read):
    return read("lineitem")


@query(f"WITH {EC} SELECT round(max(abs(ca/na-cb/nb)),9) AS ks, round(sqrt(-0.5*ln(0.05))*sqrt(any_value((na+nb)/(na*nb))),9) AS critical, max(abs(ca/na-cb/nb)) > sqrt(-0.5*ln(0.05))*sqrt(any_value((na+nb)/(na*nb))) AS drift FROM e")
def ks_drift(read):
    return rounded(t.ks(_l(read), V, first()), 9)


@query(f"WITH {EC} SELECT round(sum(abs(ca/na-cb/nb)*(nx-x)),5) AS wasserstein FROM e")
def wasserstein(read):
    return rounded(t.wasserstein(_l(read), V, first()), 5)


@query(f"WITH {EC} SELECT round(any_value(na*nb/((na+nb)*(na+nb)))*sum((a+b)*(ca/na-cb/nb)^2),7) AS cvm FROM e")
def cvm(read):
    return rounded(t.cramer_von_mises(_l(read), V, first()), 7)


@query(f"WITH g AS (SELECT count_if(l_returnflag='R') na, count_if(l_returnflag<>'R') nb, avg({V}) FILTER (l_returnflag='R') ma, avg({V}) FILTER (l_returnflag<>'R') mb, var_samp({V}) FILTER (l_returnflag='R') va, var_samp({V}) FILTER (l_returnflag<>'R') vb FROM lineitem) SELECT round((ma-mb)/sqrt(((na-1)*va+(nb-1)*vb)/(na+nb-2)*(1.0/na+1.0/nb)),7) AS t FROM g")
def t_stat(read):
    return rounded(t.t_statistic(_l(read), V, first()), 7)


@query(f"WITH {RK}, s AS (SELECT count_if(g='R')::DOUBLE na, count_if(g<>'R')::DOUBLE nb, sum(r) FILTER (g='R') ra, any_value(n)::DOUBLE n FROM r) SELECT round(ra-na*(na+1)/2,1) AS u, round((ra-na*(na+1)/2-na*nb/2)/sqrt(na*nb/12*(n+1-t/(n*(n-1)))),7) AS z FROM s, tie")
def mann_whitney(read):
    r = t.mann_whitney(_l(read), V, first())
    return r.select(F.round("u", 1).alias("u"), F.round("z", 7).alias("z"))


@query(f"WITH {RK}, s AS (SELECT g, count(*)::DOUBLE k, sum(r) s, any_value(n)::DOUBLE n FROM r GROUP BY g) SELECT round((12.0/(any_value(n)*(any_value(n)+1))*sum(s*s/k)-3*(any_value(n)+1))/(1-any_value(t)/(any_value(n)^3-any_value(n))),6) AS h FROM s, tie")
def kruskal(read):
    return rounded(t.kruskal(_l(read), V, F.col("l_returnflag")), 6)


@query(f"""WITH m AS (SELECT l_returnflag g, median({V}) m FROM lineitem GROUP BY 1), z AS (SELECT g, abs({V}-m) z FROM lineitem JOIN m ON l_returnflag=g), g AS (SELECT count(*) n, avg(z) m, var_pop(z) v FROM z GROUP BY g), a AS (SELECT avg(z) gm FROM z)
SELECT round(sum(n*(m-gm)^2)/(count(*)-1)/(sum(n*v)/(sum(n)-count(*))),7) AS w FROM g, a""")
def levene(read):
    return rounded(t.levene(_l(read), V, "l_returnflag"), 7)


@query(f"""WITH g AS (SELECT count(*)::DOUBLE n, var_samp({V}) v FROM lineitem GROUP BY l_returnflag), x AS (SELECT sum(n) N, count(*) k, sum((n-1)*v) s, sum((n-1)*ln(v)) l, sum(1/(n-1)) q FROM g)
SELECT round(((N-k)*ln(s/(N-k))-l)/(1+(q-1/(N-k))/(3*(k-1))),6) AS bartlett FROM x""")
def bartlett(read):
    return rounded(t.bartlett(_l(read), V, "l_returnflag"), 6)


@query(f"""WITH m AS (SELECT median({V}) m FROM lineitem), c AS (SELECT count_if(l_returnflag='R' AND {V}>m)::DOUBLE a, count_if(l_returnflag<>'R' AND {V}>m)::DOUBLE b, count_if(l_returnflag='R' AND {V}<=m)::DOUBLE c, count_if(l_returnflag<>'R' AND {V}<=m)::DOUBLE d FROM lineitem, m)
SELECT round((a+b+c+d)*greatest(0,abs(a*d-b*c)-(a+b+c+d)/2)^2/((a+b)*(c+d)*(a+c)*(b+d)),8) AS chi_square FROM c""")
def mood_median(read):
    return rounded(t.median_test(_l(read), V, first()), 8)


@query(f"WITH {RK}, s AS (SELECT sum((r-(n+1)/2.0)^2) FILTER (g='R') s, count_if(g='R')::DOUBLE m, any_value(n)::DOUBLE n FROM r) SELECT round((s-m*(n*n-1)/12)/sqrt(m*(n-m)*(n+1)*(n*n-4)/180),6) AS z FROM s")
def mood_scale(read):
    return rounded(t.mood_scale(_l(read), V, first()), 6)


@query(f"WITH {RK} SELECT round(sum(least(r,n+1-r)) FILTER (g='R'),1) AS ab FROM r")
def ansari(read):
    return rounded(t.ansari(_l(read), V, first()), 1)


@query("""WITH d AS (SELECT l_discount*100-l_tax*100 d FROM lineitem), e AS (SELECT round(d)::INT d FROM d WHERE round(d)<>0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d))-1)/2.0 r FROM e)
SELECT round(least(sum(CASE WHEN d>0 THEN r ELSE 0 END), sum(CASE WHEN d<0 THEN r ELSE 0 END)),1)::DOUBLE AS w, count(*) AS n FROM r""")
def wilcoxon(read):
    d = _l(read).select(F.round(F.col("l_discount") * 100).cast("int").alias("a"), F.round(F.col("l_tax") * 100).cast("int").alias("b"))
    return rounded(t.wilcoxon(d, "a", "b"), 1)


@query("""WITH x AS (SELECT l_quantity/50 a, l_discount*10 b, l_tax*12.5 c FROM lineitem), r AS (SELECT 1+(b<a)::INT+(c<a)::INT+0.5*((b=a)::INT+(c=a)::INT) ra, 1+(a<b)::INT+(c<b)::INT+0.5*((a=b)::INT+(c=b)::INT) rb, 1+(a<c)::INT+(b<c)::INT+0.5*((a=c)::INT+(b=c)::INT) rc FROM x), s AS (SELECT count(*)::DOUBLE n, sum(ra)::DOUBLE a, sum(rb)::DOUBLE b, sum(rc)::DOUBLE c FROM r)
SELECT round(12.0/(n*12)*(a*a+b*b+c*c)-12*n,3) AS chi_square FROM s""")
def friedman(read):
    d = _l(read).select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12.5).alias("c"))
    return rounded(t.friedman(d, ["a", "b", "c"]), 3)


@query("""WITH m AS (SELECT avg(value) m FROM events), k AS (SELECT count(*) n, avg((value-m)^2) v, avg((value-m)^3) c, avg((value-m)^4) q FROM events, m)
SELECT round(n/6.0*((c/pow(v,1.5))^2+(q/(v*v)-3)^2/4),3) AS jb, round(exp(-n/12.0*((c/pow(v,1.5))^2+(q/(v*v)-3)^2/4)),9) AS p FROM k""")
def jarque_bera(read):
    r = t.jarque_bera(read("events"), "value")
    return r.select(F.round("jb", 3).alias("jb"), F.round("p", 9).alias("p"))


@query()
def anderson_normal(read):
    return rounded(t.anderson_normal(read("events"), "value"), 4)


@query()
def zhang(read):
    return rounded(t.zhang(_l(read), V, first()), 6)
