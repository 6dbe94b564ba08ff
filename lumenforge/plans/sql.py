"""SQL of queries where it is made from parts: chance by a hash, series, greedy and iterative steps.

Each entry is for the query of that name in the other modules.  Iterations of a fixed number are written
out as one step after another.
"""

from __future__ import annotations

from math import exp, log

import numpy as np

from ..operators.learners import LEARNERS
from .bandits import IT, A
from .information import SEL
from .series import SER
from .similarity import PS
from .text import TOK
from .text_more import SENT
from .twosample import EC

SQL: dict[str, str] = {}


def hashed(seed, *key: str) -> str:
    return f"('0x'||substr(md5(concat_ws(':','{seed}',{','.join(f'({k})::VARCHAR' for k in key)})),1,10))::BIGINT"


def uniform(seed, *key: str) -> str:
    return f"(({hashed(seed, *key)}+0.5)/1099511627776.0::DOUBLE)"


# chance by a hash

SQL["thompson"] = f"WITH {A} SELECT arm, round(m+sqrt(-2*ln({uniform(1, 'arm')}))*cos(6.283185307179586*{uniform(2, 'arm')})*sqrt(v/n),6) AS draw FROM a"
SQL["random_greedy"] = f"""WITH e AS (SELECT user_id g, event_type arm, avg(value) m FROM events GROUP BY 1,2), b AS (SELECT g, list(arm ORDER BY arm) arms, first(arm ORDER BY m DESC, arm DESC) best FROM e GROUP BY 1)
SELECT g, CASE WHEN {uniform(3, 'g')} < 0.1 THEN arms[(floor({uniform(4, 'g')}*len(arms))+1)::INT] ELSE best END AS arm FROM b"""
SQL["exp3"] = f"WITH {A}, w AS (SELECT arm, exp(0.1*m/500*n/1000) w FROM a) SELECT arm, round(0.9*w/sum(w) OVER ()+0.1/count(*) OVER (),6) AS p FROM w"


def _poisson(u: str, rate: float) -> str:
    p, total, out = exp(-rate), 0.0, []
    for i in range(12):
        total += p
        out.append(f"({u}>{total!r})::INT")
        p *= rate / (i + 1)
    return "+".join(out)


SQL["bagging"] = f"WITH k AS (SELECT o_orderkey, o_totalprice, {uniform(1, 'o_orderkey')} u FROM orders), c AS (SELECT *, {_poisson('u', 1.0)} k FROM k) SELECT o_orderkey, o_totalprice, unnest(range(1, k+1))::INT AS copy FROM c WHERE k>0"
SQL["under_sample"] = f"WITH n AS (SELECT toxic, count(*) n FROM labels GROUP BY 1), p AS (SELECT toxic, (SELECT min(n) FROM n)*1.0::DOUBLE/n p FROM n) SELECT toxic, doc_id FROM labels JOIN p USING (toxic) WHERE {uniform(1, 'doc_id')} < p"
SQL["smote"] = f"""WITH {PS}, l AS (SELECT p_type t FROM part GROUP BY 1 ORDER BY count(*), p_type LIMIT 1), q AS (SELECT p.*, p_retailprice z FROM p JOIN part ON k=p_partkey WHERE g=(SELECT t FROM l)), w AS (SELECT k, [lead(k,1) OVER o, lead(k,2) OVER o, lead(k,3) OVER o] n FROM q WINDOW o AS (PARTITION BY b ORDER BY y, k)), e AS (SELECT k src, unnest(n) dst FROM w)
SELECT src, dst, round(a.x+{uniform(1, 'src', 'dst')}*(b.x-a.x),6) AS p_size, round(a.y+{uniform(1, 'src', 'dst')}*(b.y-a.y),6) AS p_retailprice FROM e JOIN q a ON a.k=src JOIN q b ON b.k=dst"""
SQL["batch_greedy"] = f"WITH {IT}, r AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY (n=0)::INT DESC, round(CASE WHEN {uniform(2, '3', 'grp', 'item')} < {0.5 * min(1.0, 1 / 3)!r} THEN 1e9+{uniform(1, '3', 'grp', 'item')} ELSE m END,9) DESC, item) rank FROM x) SELECT grp, item, rank::INT AS rank FROM r WHERE rank<=2"
SQL["batch_softmax"] = f"WITH {IT}, r AS (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY (n=0)::INT DESC, round(m/20.0-ln(-ln({uniform(1, 'grp', 'item')})),9) DESC, item) rank FROM x) SELECT grp, item, rank::INT AS rank FROM r WHERE rank<=2"
SQL["sample_percent"] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE {uniform(1, 'o_orderkey')} < 0.1"
SQL["sample_weighted"] = f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY ln({uniform(1, 'o_orderkey')})/o_totalprice DESC, o_orderkey LIMIT 100"
SQL["block_shuffle"] = f"SELECT event_id, event_id//100 AS block, {uniform(1, 'event_id//100')} AS u FROM events"
SQL["bootstrap_extremes"] = f"WITH r AS (SELECT 1000.0::DOUBLE/count(*) r FROM orders), s AS (SELECT unnest(range(0,20))::INT s) SELECT s AS sample, min(o_totalprice) AS least, max(o_totalprice) AS greatest FROM orders, r, s WHERE {uniform(1, 'o_orderkey', 's')} < 1-exp(-r) GROUP BY 1"
SQL["sample_in_batches"] = f"WITH p AS (SELECT o_orderkey slot, o_orderkey//500 b, floor({uniform(1, 'o_orderkey')}*500)::BIGINT i FROM orders) SELECT slot, o_orderkey, o_totalprice FROM p JOIN orders ON o_orderkey//500=b AND o_orderkey%500=i"
_Z = f"(sqrt(-2*ln({uniform(1, 'o_orderkey')}))*cos(2*3.141592653589793*{uniform(2, 'o_orderkey')}))"
SQL["loo_encode_noise"] = f"WITH y AS (SELECT o_orderkey, o_orderpriority p, (o_orderstatus='F')::INT y FROM orders), s AS (SELECT p, count(*) n, sum(y) s FROM y GROUP BY 1) SELECT o_orderkey, round((s-y)/(n-1+10.0)*(1+0.3*greatest(-2.0,least(2.0,{_Z}))),9) AS code FROM y JOIN s USING (p)"
SQL["hash_encode"] = "SELECT o_orderkey, " + ", ".join(f"CASE WHEN {hashed(1, 'o_orderpriority')}%8={i} THEN CASE WHEN {hashed(2, 'o_orderpriority')}%2=1 THEN 1 ELSE -1 END ELSE 0 END AS h{i}" for i in range(8)) + " FROM orders"


def _mutated(c: str, seed: int) -> str:
    h = hashed(seed, "n")
    at = f"({h}%greatest(length(n),1)+1)"
    old = f"substr({c},{at},1)"
    new = f"CASE WHEN regexp_matches({old},'[0-9]') THEN chr((48+({h}>>8)%10)::INT) WHEN regexp_matches({old},'[A-Za-z]') THEN chr((97+({h}>>8)%26)::INT) ELSE {old} END"
    return f"substr({c},1,{at}-1)||{new}||substr({c},{at}+1)"


SQL["mutate_strings"] = f"WITH a AS (SELECT c_custkey, c_name n FROM customer), b AS (SELECT c_custkey, n, {_mutated('n', 1)} o FROM a) SELECT c_custkey, {_mutated('o', 2)} AS name FROM b"
_RNG = np.random.default_rng(1)
_PLACES = [(i, float(_RNG.uniform()), float(_RNG.uniform())) for i in range(100)]
SQL["hopkins"] = f"""WITH {PS}, l AS (SELECT min(x) lx, max(x) hx, min(y) ly, max(y) hy FROM p), q AS (SELECT 'r'||i AS k, 'random' AS kind, lx+(hx-lx)*u AS cx, ly+(hy-ly)*v AS cy FROM (VALUES {",".join(f"({i},{u!r},{v!r})" for i, u, v in _PLACES)}) t(i,u,v), l UNION ALL (SELECT k::VARCHAR, 'row', x, y FROM p ORDER BY {uniform(1, 'k')} LIMIT 100)),
d AS (SELECT q.kind, q.k, min(sqrt((x-cx)^2+(y-cy)^2)) d FROM q JOIN p ON p.k::VARCHAR<>q.k GROUP BY 1,2) SELECT round(sum(d) FILTER (kind='random')/sum(d),6) AS hopkins FROM d"""

# learners: two actions after the rewards; the draws of a generator are the same for every group, and stand as numbers


def _u(t: int) -> float:
    return float(np.random.default_rng([1, t]).random())


_L = f"{IT}, s AS (SELECT user_id g, event_type a, var_pop(value/500) v FROM events GROUP BY 1,2), l AS (SELECT grp, item, n, m/500 m, sqrt(greatest(0, coalesce(v,0))) d, count(*) OVER (PARTITION BY grp) k, row_number() OVER (PARTITION BY grp ORDER BY item) i FROM x LEFT JOIN s ON g=grp AND a=item)"


def _drawn(weight: str, t: int) -> str:
    """The first item whose cumulated share exceeds the t-th draw."""
    return f"d{t} AS (SELECT grp, min(item) FILTER (c > {_u(t)!r}) item FROM (SELECT grp, item, sum(w) OVER (PARTITION BY grp ORDER BY i)/sum(w) OVER (PARTITION BY grp) c FROM (SELECT *, {weight} w FROM l)) GROUP BY 1)"


def _two(a: str, b: str) -> str:
    return f"WITH {_L}, {a}, {b} SELECT d1.grp AS grp, d1.item||','||d2.item AS actions FROM d1 JOIN d2 ON d1.grp=d2.grp"


_FIRST = "d{t} AS (SELECT grp, item FROM l WHERE i={t})"
for _n in ("upperConfidenceBoundOne", "upperConfidenceBoundTwo"):
    SQL[f"learner_{_n}"] = _two(_FIRST.format(t=1), _FIRST.format(t=2))
_top = "max(m) OVER (PARTITION BY grp)"
SQL["learner_softMax"] = _two(*(_drawn(f"exp((m-{_top})/{max(0.01, 1 / t)!r})", t) for t in (1, 2)))
_best = "(row_number() OVER (PARTITION BY grp ORDER BY round(m,12) DESC, item)=1)"
SQL["learner_actionPursuit"] = _two(*(_drawn(f"1.0/k+0.05*({_best}::INT-1.0/k)", t) for t in (1, 2)))
SQL["learner_exponentialWeightExpert"] = _two(*(_drawn("1.0", t) for t in (1, 2)))


def _greedy(t: int) -> str:
    g = np.random.default_rng([1, t])
    if g.random() < 0.5 * min(1.0, 1 / t):
        at = "CASE k " + " ".join(f"WHEN {k} THEN {1 + int(_again(t).integers(k))}" for k in range(1, 13)) + " END"
        return f"d{t} AS (SELECT grp, item FROM l WHERE i={at})"
    return f"d{t} AS (SELECT grp, first(item ORDER BY round(m,12) DESC, item) item FROM l GROUP BY 1)"


def _again(t: int) -> np.random.Generator:
    g = np.random.default_rng([1, t])
    g.random()
    return g


SQL["learner_randomGreedy"] = _two(_greedy(1), _greedy(2))
_few = [{k: 1 + int(np.random.default_rng([1, t]).integers(k)) for k in range(1, 13)} for t in (1, 2)]
SQL["learner_intervalEstimator"] = _two(*(f"d{t} AS (SELECT grp, CASE WHEN min(n)<3 THEN first(item) FILTER (i=(CASE k {' '.join(f'WHEN {k} THEN {v}' for k, v in _few[t - 1].items())} END)) ELSE first(item ORDER BY round(m+1.959963984540054*d/sqrt(greatest(n,1)),12) DESC, item) END item FROM l GROUP BY grp)" for t in (1, 2)))
_SEEN = "ev AS MATERIALIZED (SELECT user_id g, event_type a, value/500 r, row_number() OVER (PARTITION BY user_id ORDER BY event_id) t FROM events)"
# rewards one after another: a reference that follows the arm's mean; weights that grow with rewards over shares
SQL["learner_rewardComparison"] = f"""WITH RECURSIVE {_L}, {_SEEN}, mm AS MATERIALIZED (SELECT g, a, t, avg(r) OVER (PARTITION BY g, a ORDER BY t ROWS UNBOUNDED PRECEDING) m FROM ev), rf AS (SELECT g, t, 0.0::DOUBLE b, m FROM mm WHERE t=1 UNION ALL SELECT mm.g, mm.t, b+0.1*(rf.m-b), mm.m FROM rf JOIN mm ON mm.g=rf.g AND mm.t=rf.t+1),
pf AS (SELECT mm.g, mm.a, 0.1*sum(mm.m-b) q FROM mm JOIN rf ON rf.g=mm.g AND rf.t=mm.t GROUP BY 1,2), lq AS (SELECT grp, item, i, coalesce(q,0) q FROM l LEFT JOIN pf ON pf.g=grp AND pf.a=item), """ + ", ".join(_drawn("exp(q-max(q) OVER (PARTITION BY grp))", t).replace("FROM l)", "FROM lq)") for t in (1, 2)) + " SELECT d1.grp AS grp, d1.item||','||d2.item AS actions FROM d1 JOIN d2 ON d1.grp=d2.grp"
_share = "(0.9*exp(w[j]-list_max(w))/list_sum(list_transform(w, lambda x: exp(x-list_max(w))))+0.1/len(w))"
SQL["learner_exponentialWeight"] = f"""WITH RECURSIVE {_L}, {_SEEN}, arms AS (SELECT item, i, k FROM l QUALIFY row_number() OVER (PARTITION BY item ORDER BY grp)=1), es AS MATERIALIZED (SELECT g, t, r, i j, k FROM ev JOIN arms ON item=a), st AS (SELECT DISTINCT g, 0::BIGINT t, list_transform(range(0,k), lambda x: 0.0::DOUBLE) w FROM es UNION ALL SELECT g, t, list_transform(w, lambda x, n: CASE WHEN n=j THEN x+0.1*r/({_share}*len(w)) ELSE x END) FROM (SELECT es.g, es.t, es.r, es.j, st.w FROM st JOIN es ON es.g=st.g AND es.t=st.t+1)),
fin AS (SELECT g, w FROM st QUALIFY row_number() OVER (PARTITION BY g ORDER BY t DESC)=1), lq AS (SELECT grp, item, i, {_share} q FROM (SELECT l.grp, l.item, l.i, fin.w, l.i j FROM l JOIN fin ON g=grp)), """ + ", ".join(_drawn("q", t).replace("FROM l)", "FROM lq)") for t in (1, 2)) + " SELECT d1.grp AS grp, d1.item||','||d2.item AS actions FROM d1 JOIN d2 ON d1.grp=d2.grp"
assert {k.removeprefix("learner_") for k in SQL if k.startswith("learner_")} <= set(LEARNERS)

SQL |= {k.replace("learner_", "stream_"): q for k, q in SQL.items() if k.startswith("learner_")}  # the stream gives what the batch gives

# laws of distribution

_ND = "WITH m AS (SELECT avg(value) m, stddev_samp(value) s, count(*)::DOUBLE n FROM events), x AS (SELECT row_number() OVER (ORDER BY value) i, value v FROM events), "
_AD = "round(-any_value(n)-sum((2*i-1)*ln(f)+(2*(n-i)+1)*ln(1-f))/any_value(n),4)"
_clip = "least(1-1e-12,greatest(1e-12,{}))".format
_T = "(1/(1+0.2316419*abs(z)))"
_TAIL = f"(exp(-z*z/2)/2.5066282746310002*{_T}*(0.319381530+{_T}*(-0.356563782+{_T}*(1.781477937+{_T}*(-1.821255978+{_T}*1.330274429)))))"
SQL["anderson_normal"] = f"{_ND} z AS (SELECT i, n, (v-m)/s z FROM x, m), c AS (SELECT i, n, {_clip(f'CASE WHEN z>=0 THEN 1-{_TAIL} ELSE {_TAIL} END')} f FROM z) SELECT {_AD} AS a2 FROM c"
SQL["anderson_logistic"] = f"{_ND} c AS (SELECT i, n, {_clip('1/(1+exp(-(v-m)/(s*sqrt(3)/pi())))')} f FROM x, m) SELECT {_AD} AS a2 FROM c"
_SC = "(s*sqrt(6)/pi())"
SQL["anderson_gumbel"] = f"{_ND} c AS (SELECT 'gumbel_r' law, i, n, {_clip(f'exp(-exp(-(v-(m-0.5772156649015329*{_SC}))/{_SC}))')} f FROM x, m UNION ALL SELECT 'gumbel_l', i, n, {_clip(f'1-exp(-exp((v-(m+0.5772156649015329*{_SC}))/{_SC}))')} FROM x, m) SELECT law, {_AD} AS a2 FROM c GROUP BY 1"


def _ad_part(c: str, f: str, size: str) -> str:
    return f"(n*({c}-{f}/2)-b0*{size})^2/{size}"


SQL["anderson_two"] = f"""WITH {EC}, f AS (SELECT *, na+nb n, a+b k, ca+cb-(a+b)/2 b0 FROM e), s AS (SELECT any_value(na) na, any_value(nb) nb, any_value(n) n, sum(k/n*({_ad_part('ca', 'a', 'na')}+{_ad_part('cb', 'b', 'nb')})/(b0*(n-b0)-n*k/4)) s FROM f),
t AS (SELECT i, sum(1.0::DOUBLE/i) OVER (ORDER BY i) h FROM (SELECT unnest(range(1, (SELECT n::BIGINT FROM s))) i)), g AS (SELECT max(h) h, (SELECT sum((q.m-t.h)/((SELECT n FROM s)-t.i)) FROM t, (SELECT max(h) m FROM t) q WHERE t.i<=(SELECT n FROM s)-2) g FROM t),
w AS (SELECT *, 1/na+1/nb a FROM s, g), out AS (SELECT s*(n-1)/n a2, ((4*g-6)+(10-6*g)*a)*n^3+((2*g-4)*4+16*h+(2*g-14*h-4)*a-8*h+4*g-6)*n^2+((6*h+2*g-2)*4+2*(4*h-4*g+6)+(2*h-6)*a+4*h)*n+((2*h+6)*4-8*h) p, (n-1)*(n-2)*(n-3) q FROM w)
SELECT round(a2,6) AS a2, round((a2-1)/sqrt(p/q),6) AS standard FROM out"""
_q = "(p-0.5)"


def _horner(k: tuple, x: str, last: str | None = None) -> str:
    out = repr(k[0])
    for v in k[1:]:
        out = f"({out}*{x}+{v!r})"
    return out if last is None else f"({out}*{x}+{last})"


#: coefficients of the normal quantile: fixed values
_QA = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_QB = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_QC = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_QD = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_r, _t = f"({_q}*{_q})", "sqrt(-2*ln(1-p))"
_quantile = f"CASE WHEN p>1-0.02425 THEN -{_horner(_QC, _t)}/{_horner(_QD, _t, '1.0')} ELSE {_horner(_QA, _r)}*{_q}/{_horner(_QB, _r, '1.0')} END"
SQL["fligner"] = f"""WITH m AS (SELECT l_returnflag g, median(l_extendedprice) m FROM lineitem GROUP BY 1), d AS (SELECT g, abs(l_extendedprice-m) d FROM lineitem JOIN m ON l_returnflag=g), r AS (SELECT g, (rank() OVER (ORDER BY d)+(count(*) OVER (PARTITION BY d)-1)/2.0::DOUBLE)/(2*(count(*) OVER ()+1))+0.5 p FROM d), a AS (SELECT g, {_quantile} a FROM r), k AS (SELECT g, count(*) k, avg(a) m FROM a GROUP BY 1)
SELECT round(sum(k*(m-(SELECT avg(a) FROM a))^2)/(SELECT var_samp(a) FROM a),6) AS fligner FROM k"""
_xlog = "(CASE WHEN {0}<=0 THEN 0 ELSE {0}*ln({0}/{1}) END)".format
_zp = lambda f, m: f"{m}*({_xlog(f'({f}/{m})', 'p')}+{_xlog(f'(1-{f}/{m})', '(1-p)')})"
_ze = lambda f, m: f"{m}*({_xlog(f'({f}/{m})', '1')}+{_xlog(f'(1-{f}/{m})', '1')})"
SQL["zhang"] = f"WITH {EC}, f AS (SELECT *, na+nb n, ca+cb c, (ca+cb-0.5)/(na+nb) p FROM e) SELECT round(max({_zp('ca', 'na')}+{_zp('cb', 'nb')}),6) AS zk, round(sum(({_ze('ca', 'na')}+{_ze('cb', 'nb')})/((c-0.5)*(n-c+0.5))*(a+b)),6) AS za FROM f"
SQL["p_values"] = """WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE n FROM orders GROUP BY 1,2), e AS (SELECT n, sum(n) OVER (PARTITION BY a)*sum(n) OVER (PARTITION BY b)/sum(n) OVER () e FROM c), x AS (SELECT sum((n-e)^2/e)/2 x FROM e),
g AS (SELECT l_returnflag f, count(*)::DOUBLE n, avg(l_quantity) m, var_pop(l_quantity) v FROM lineitem GROUP BY 1), f AS (SELECT sum(n) n, sum(n*(m-(SELECT avg(l_quantity) FROM lineitem))^2)/2/(sum(n*v)/(sum(n)-3)) f FROM g),
r AS (SELECT r, abs(r)*sqrt((n-2)/(1-r*r)) t, n-2 v FROM (SELECT corr(l_quantity,l_extendedprice) r, count(*)::DOUBLE n FROM lineitem)), h AS (SELECT unnest(range(0,4001)) i)
SELECT 'chi_square' AS test, round(exp(-x)*(1+x+x^2/2+x^3/6),9) AS p FROM x UNION ALL SELECT 'anova', round(pow(1+2*f/(n-3),-(n-3)/2),9) FROM f UNION ALL SELECT 'pearson', round(greatest(0,1-2*any_value(exp(lgamma((v+1)/2)-lgamma(v/2))/sqrt(v*pi()))*sum(pow(1+(t*i/4000)^2/v,-(v+1)/2)*CASE WHEN i IN (0,4000) THEN 1 WHEN i%2=1 THEN 4 ELSE 2 END)*any_value(t)/12000),9) FROM r, h"""

# series

SQL["partial_autocorr"] = ""  # set below


def _durbin(lags: int) -> str:
    c = f"{SER}, c AS (SELECT k, i, x-avg(x) OVER (PARTITION BY k) c, count(*) OVER (PARTITION BY k) n FROM s)"
    r = ", ".join(f"CASE WHEN any_value(n)>{j} THEN coalesce(sum(c*l{j}),0)/v END r{j}" for j in range(1, lags + 1))
    l = ", ".join(f"lag(c,{j}) OVER (PARTITION BY k ORDER BY i) l{j}" for j in range(1, lags + 1))
    out = f"WITH {c}, l AS (SELECT k, c, n, {l} FROM c), v AS (SELECT k, CASE WHEN sum(c*c)=0 THEN 1.0 ELSE sum(c*c) END v FROM c GROUP BY 1), p1 AS (SELECT *, r1 AS a1, r1 AS f1_1 FROM (SELECT k, {r} FROM l JOIN v USING (k) GROUP BY k, v))"
    for m in range(2, lags + 1):
        num = f"r{m}-(" + "+".join(f"f{m - 1}_{j}*r{m - j}" for j in range(1, m)) + ")"
        den = "1-(" + "+".join(f"f{m - 1}_{j}*r{j}" for j in range(1, m)) + ")"
        out += f", q{m} AS (SELECT *, ({num})/CASE WHEN abs({den})>1e-15 THEN {den} ELSE 1e-15 END AS a{m} FROM p{m - 1}), p{m} AS (SELECT *, " + ", ".join(f"f{m - 1}_{j}-a{m}*f{m - 1}_{m - j} AS f{m}_{j}" for j in range(1, m)) + f", a{m} AS f{m}_{m} FROM q{m})"
    return out + " " + " UNION ALL ".join(f"SELECT k, {j}::BIGINT AS lag, round(a{j},8) AS pacf FROM p{lags} WHERE a{j} IS NOT NULL" for j in range(1, lags + 1))


SQL["partial_autocorr"] = _durbin(5)
SQL["hurst_exponent"] = f"""WITH {SER}, z AS (SELECT k, count(*) n FROM s GROUP BY 1), b AS (SELECT z.k, z.n len, w FROM z, (SELECT unnest([{','.join(str(8 << e) for e in range(16))}]) w) WHERE w<=n//2 OR w=8 AND n>=8), m AS (SELECT s.k, w, i//w b, i, x-avg(x) OVER (PARTITION BY s.k, w, i//w) d, stddev_pop(x) OVER (PARTITION BY s.k, w, i//w) sd FROM s JOIN b ON s.k=b.k AND i<len//w*w),
c AS (SELECT k, w, b, sd, sum(d) OVER (PARTITION BY k, w, b ORDER BY i) c FROM m), r AS (SELECT k, w, b, (max(c)-min(c))/any_value(sd) r FROM c WHERE sd>0 GROUP BY 1,2,3), g AS (SELECT k, ln(w) x, ln(avg(r)) y FROM r GROUP BY k, w)
SELECT z.k, round(CASE WHEN count(y)>1 THEN regr_slope(y, x) ELSE 'nan'::DOUBLE END,6) AS hurst FROM z LEFT JOIN g ON g.k=z.k GROUP BY z.k"""
_EMB = "t AS (SELECT k, i, x a, lead(x,1) OVER o b, lead(x,2) OVER o c FROM s WINDOW o AS (PARTITION BY k ORDER BY i)), d AS (SELECT k, 0.2*stddev_pop(x) tol, count(*) n FROM s GROUP BY 1)"
_PHI = lambda cols: f"(SELECT k, avg(ln(f)) p FROM (SELECT u.k, u.i, avg((greatest({', '.join(f'abs(u.{c}-v.{c})' for c in cols)})<=tol)::INT) f FROM t u JOIN t v ON u.k=v.k JOIN d ON d.k=u.k WHERE u.{cols[-1]} IS NOT NULL AND v.{cols[-1]} IS NOT NULL GROUP BY 1,2) GROUP BY 1)"
SQL["approx_entropy"] = f"WITH {SER}, {_EMB}, p AS {_PHI('ab')}, q AS {_PHI('abc')} SELECT d.k, round(CASE WHEN n>3 THEN p.p-q.p ELSE 0 END,6) AS entropy FROM d LEFT JOIN p ON p.k=d.k LEFT JOIN q ON q.k=d.k"
SQL["discord"] = f"""WITH {SER}, t AS (SELECT k, i, x a, lead(x,1) OVER o b, lead(x,2) OVER o c, lead(x,3) OVER o d, lead(x,4) OVER o e, count(*) OVER (PARTITION BY k) n FROM s WINDOW o AS (PARTITION BY k ORDER BY i)), w AS (SELECT * FROM t WHERE e IS NOT NULL AND n>=10),
p AS (SELECT u.k, u.i, coalesce(min(sqrt({'+'.join(f'(u.{c}-v.{c})^2' for c in 'abcde')})),-1) d FROM w u LEFT JOIN w v ON u.k=v.k AND abs(u.i-v.i)>=5 GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(d,9) DESC, i) r FROM p) SELECT k, i AS at, round(d,6) AS dist FROM r WHERE r=1"""
_CRIT = lambda row: "+".join(f"({c!r})/n^{i}" for i, c in enumerate(row))
#: critical values of the unit root test: fixed values
_SURFACE = ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.04), (-2.56677, -1.5384, -2.809, 0.0))
SQL["adf_test"] = f"""WITH {SER}, d AS (SELECT k, i, x-lag(x,1) OVER o y, lag(x,1) OVER o p, lag(x,1) OVER o-lag(x,2) OVER o q FROM s WINDOW o AS (PARTITION BY k ORDER BY i)), m AS (SELECT k, count(*)::DOUBLE n, covar_pop(p,p)*count(*) pp, covar_pop(q,q)*count(*) qq, covar_pop(p,q)*count(*) pq, covar_pop(p,y)*count(*) py, covar_pop(q,y)*count(*) qy, covar_pop(y,y)*count(*) yy FROM d WHERE q IS NOT NULL GROUP BY 1 HAVING count(*)>4),
b AS (SELECT *, pp*qq-pq*pq det FROM m), c AS (SELECT *, (qq*py-pq*qy)/det b1, (pp*qy-pq*py)/det b2 FROM b), t AS (SELECT k, n, b1/sqrt((yy-b1*py-b2*qy)/(n-3)*qq/det) t FROM c)
SELECT k, round(t,6) AS t, round({_CRIT(_SURFACE[0])},6) AS c1, round({_CRIT(_SURFACE[1])},6) AS c5, round({_CRIT(_SURFACE[2])},6) AS c10, t<{_CRIT(_SURFACE[1])} AS stationary FROM t"""
SQL["kpss_test"] = f"""WITH {SER}, e AS (SELECT k, i, x-avg(x) OVER (PARTITION BY k) e, count(*) OVER (PARTITION BY k) n FROM s), l AS (SELECT DISTINCT k, n, least(n-1, ceil(12*pow(n/100.0::DOUBLE,0.25)))::BIGINT l FROM e), a AS (SELECT u.k, sum((1-(u.i-v.i)/(l.l+1.0::DOUBLE))*u.e*v.e) a FROM e u JOIN l ON l.k=u.k JOIN e v ON u.k=v.k AND u.i-v.i BETWEEN 1 AND l.l GROUP BY 1),
c AS (SELECT k, e, sum(e) OVER (PARTITION BY k ORDER BY i) c FROM e), q AS (SELECT c.k, sum(c*c) c2, sum(e*e) e2 FROM c GROUP BY 1), t AS (SELECT l.k, l.l, e2/n+2.0/n*coalesce(a,0) s2, c2, n FROM l JOIN q ON q.k=l.k LEFT JOIN a ON a.k=l.k), u AS (SELECT k, l, CASE WHEN s2=0 THEN 0 ELSE c2/(n*n)/s2 END t FROM t)
SELECT k, round(t,6) AS stat, round(CASE WHEN t<=0.347 THEN 0.1 WHEN t<0.463 THEN 0.1-(t-0.347)/0.116*0.05 WHEN t<0.574 THEN 0.05-(t-0.463)/0.111*0.025 WHEN t<0.739 THEN 0.025-(t-0.574)/0.165*0.015 ELSE 0.01 END,6) AS p, l AS lags FROM u"""
SQL["forecast"] = f"""WITH RECURSIVE {SER}, n AS (SELECT k, count(*) n, list(x ORDER BY i) x FROM s GROUP BY 1), b AS (SELECT k, n, x, list_avg(x[1:7]) l, list_avg(x[8:14])-list_avg(x[1:7]) d FROM n WHERE n>=14),
h AS (SELECT k, n, x, 7 t, l, d/7 b, list_transform(x[1:7], lambda v: v-l) s FROM b UNION ALL SELECT k, n, x, t+1, nl, 0.05*(nl-l)+0.95*b, s[1:t%7]||[0.2*(x[t+1]-nl)+0.8*s[t%7+1]]||s[t%7+2:7] FROM (SELECT *, 0.3*(x[t+1]-s[t%7+1])+0.7*(l+b) nl FROM h WHERE t<n)),
f AS (SELECT k, n, l, b, s FROM h WHERE t=n), a AS (SELECT unnest([1,2,3])::BIGINT a)
SELECT k, a AS ahead, round(l+a*b+s[(n+a-1)%7+1],6) AS x FROM f, a UNION ALL SELECT k, a, round(list_avg(x),6) FROM n, a WHERE n<14"""

# feature scores: greedy steps over the table of single features and pairs

_h = lambda cols: f"(SELECT ln(sum(n))-sum(n*ln(n))/sum(n) FROM (SELECT count(*)::DOUBLE n FROM lineitem GROUP BY {', '.join(SEL.get(c, c) for c in cols)}))"
_names = list(SEL)
_ONE = "one AS (SELECT f, h, hxy, h+(SELECT hy FROM y)-hxy mi FROM (" + " UNION ALL ".join(f"SELECT '{f}' f, {_h([f])} h, {_h([f, 'l_returnflag'])} hxy" for f in _names) + "))"
_TWO = "two AS (SELECT a, b, h, hxy, h+(SELECT hy FROM y)-hxy mi FROM (" + " UNION ALL ".join(f"SELECT '{a}' a, '{b}' b, {_h([a, b])} h, {_h([a, b, 'l_returnflag'])} hxy" for i, a in enumerate(_names) for b in _names[i + 1 :]) + ")), pair AS MATERIALIZED (SELECT * FROM two UNION ALL SELECT b, a, h, hxy, mi FROM two)"
_between, _given = "(o.h+s.h-p.h)", "(o.hxy+s.hxy-p.hxy-(SELECT hy FROM y))"
_SCORE = {
    "mifs": f"any_value(o.mi)-sum({_between})",
    "mrmr": f"any_value(o.mi)-avg({_between})",
    "jmi": "sum(p.mi)",
    "disr": "sum(p.mi/p.hxy)",
    "cmim": f"any_value(o.mi)-max({_between}-{_given})",
    "icap": f"any_value(o.mi)-sum(greatest(0,{_between}-{_given}))",
}
for _a, _s in _SCORE.items():
    _steps = "c0 AS MATERIALIZED (SELECT 0 k, f, mi score FROM one ORDER BY round(mi,12) DESC, f LIMIT 1)"
    for _i in range(1, len(_names)):
        _chosen = " UNION ALL ".join(f"SELECT f FROM c{j}" for j in range(_i))
        _steps += f", c{_i} AS MATERIALIZED (SELECT {_i} k, o.f, {_s} score FROM one o JOIN pair p ON p.a=o.f JOIN one s ON s.f=p.b WHERE s.f IN ({_chosen}) AND o.f NOT IN ({_chosen}) GROUP BY o.f ORDER BY round({_s},12) DESC, o.f LIMIT 1)"
    SQL[f"{_a}_scores"] = f"WITH y AS MATERIALIZED (SELECT {_h(['l_returnflag'])} hy), {_ONE.replace('one AS', 'one AS MATERIALIZED', 1)}, {_TWO}, {_steps} SELECT k AS place, f AS feature, round(score,9) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM c{j}" for j in range(len(_names))) + ")"

# learners in rounds

_bits = lambda p: f"(CASE WHEN {p}>0 AND {p}<1 THEN -({p}*log2({p})+(1-{p})*log2(1-{p})) ELSE 0 END)"
_CAND = ",".join(f"({k},'{f}',{p!r})" for k, (f, p) in enumerate([("l_quantity", 10.0), ("l_quantity", 20.0), ("l_quantity", 30.0), ("l_quantity", 40.0), ("l_discount", 0.02), ("l_discount", 0.05), ("l_discount", 0.08)]))


def _grown(depth: int) -> str:
    out = f"WITH cand AS (SELECT * FROM (VALUES {_CAND}) c(j, f, v)), r0 AS (SELECT l_quantity q, l_discount d, (l_returnflag='R')::INT y, '' path FROM lineitem)"
    leaves = []
    for i in range(depth):
        out += f""", g{i} AS (SELECT path, j, f, v, count(*)::DOUBLE N, sum(y)::DOUBLE P, count_if(CASE f WHEN 'l_quantity' THEN q ELSE d END<=v)::DOUBLE n1, coalesce(sum(y) FILTER (CASE f WHEN 'l_quantity' THEN q ELSE d END<=v),0)::DOUBLE p1 FROM r{i}, cand GROUP BY 1,2,3,4),
b{i} AS (SELECT * FROM (SELECT *, {_bits('(P/N)')}-(n1/N*{_bits('(p1/nullif(n1,0))')}+(N-n1)/N*{_bits('((P-p1)/nullif(N-n1,0))')}) gain FROM g{i}) QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, j)=1),
r{i + 1} AS (SELECT q, d, y, CASE WHEN r.path='' THEN '' ELSE r.path||' and ' END||f||CASE WHEN CASE f WHEN 'l_quantity' THEN q ELSE d END<=v THEN ' <= ' ELSE ' > ' END||printf('%g',v) path FROM r{i} r JOIN b{i} b ON b.path=r.path WHERE gain>1e-12)"""
        leaves.append(f"SELECT path, N::BIGINT AS population, round(P/N,9) AS prob FROM b{i} WHERE gain<=1e-12")
    return out + " " + " UNION ALL ".join([*leaves, f"SELECT path, count(*), round(avg(y),9) FROM r{depth} GROUP BY 1"])


SQL["tree_grow"] = _grown(2)


def _kmeans(rounds: int) -> str:
    out = "WITH p AS MATERIALIZED (SELECT l_quantity/50 q, l_discount*10 d FROM lineitem), c0 AS (SELECT * FROM (VALUES (0,0.2::DOUBLE,0.2::DOUBLE),(1,0.8,0.8),(2,0.2,0.8)) c(k,q,d))"
    for i in range(rounds):
        near = "least(" + ",".join(f"e{j}" for j in range(3)) + ")"
        e = ", ".join(f"(p.q-(SELECT q FROM c{i} WHERE k={j}))*(p.q-(SELECT q FROM c{i} WHERE k={j}))+(p.d-(SELECT d FROM c{i} WHERE k={j}))*(p.d-(SELECT d FROM c{i} WHERE k={j})) e{j}" for j in range(3))
        out += f", a{i} AS (SELECT CASE WHEN e0={near} THEN 0 WHEN e1={near} THEN 1 ELSE 2 END k, avg(q) q, avg(d) d FROM (SELECT q, d, {e} FROM p) GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(a.q,c.q) q, coalesce(a.d,c.d) d FROM c{i} c LEFT JOIN a{i} a ON a.k=c.k)"
    return out + f" SELECT k, round(q,6) AS q, round(d,6) AS d FROM c{rounds}"


SQL["kmeans_fit"] = _kmeans(10)


def _logistic(rounds: int) -> str:
    out = "WITH p AS MATERIALIZED (SELECT l_quantity/50 q, l_discount*10 d, (l_returnflag='R')::INT y FROM lineitem), w0 AS (SELECT 0.0::DOUBLE a, 0.0::DOUBLE b, 0.0::DOUBLE c)"
    for i in range(rounds):
        out += f", w{i + 1} AS MATERIALIZED (SELECT any_value(a)+avg(e) a, any_value(b)+avg(e*q) b, any_value(c)+avg(e*d) c FROM (SELECT a, b, c, q, d, y-1/(1+exp(-(a+b*q+c*d))) e FROM p, w{i}))"
    return out + " " + " UNION ALL ".join(f"SELECT {i} AS i, round({x},8) AS coefficient FROM w{rounds}" for i, x in enumerate("abc"))


SQL["logistic_fit"] = _logistic(15)
SQL["dbscan"] = f"""WITH RECURSIVE {PS}, pr AS MATERIALIZED (SELECT a.k src, b.k dst, sqrt(((a.x-b.x)^2+(a.y-b.y)^2)/2) d FROM p a JOIN p b ON a.b=b.b AND a.k<>b.k), n AS MATERIALIZED (SELECT src, dst FROM pr WHERE d<=0.03), c AS MATERIALIZED (SELECT src FROM n GROUP BY 1 HAVING count(*)+1>=4), e AS MATERIALIZED (SELECT src, dst FROM n WHERE src IN (FROM c) AND dst IN (FROM c)),
reach AS (SELECT src node, src least FROM c UNION SELECT e.dst, reach.least FROM reach JOIN e ON e.src=reach.node WHERE reach.least<e.dst), m AS MATERIALIZED (SELECT node, min(least) cluster FROM reach GROUP BY 1), b AS (SELECT n.src node, min(cluster) cluster FROM n JOIN m ON m.node=n.dst WHERE n.src NOT IN (FROM c) GROUP BY 1)
SELECT s.node, x.cluster FROM (SELECT DISTINCT src node FROM pr) s LEFT JOIN (SELECT * FROM m UNION ALL SELECT * FROM b) x ON x.node=s.node"""

# sequences

_RATES = """d AS (SELECT event_type src, lead(event_type) OVER w dst, epoch_us(lead(ts) OVER w)/1e6-epoch_us(ts)/1e6 dt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT src, sum(dt) t FROM d WHERE dst IS NOT NULL GROUP BY 1), q0 AS MATERIALIZED (SELECT d.src, d.dst, count(*)*86400.0/any_value(t) rate FROM d JOIN t ON d.src=t.src WHERE dst IS NOT NULL AND d.src<>dst GROUP BY 1,2),
z AS MATERIALIZED (SELECT DISTINCT src s FROM q0 UNION SELECT DISTINCT dst FROM q0), o AS MATERIALIZED (SELECT src, sum(rate) out FROM q0 GROUP BY 1), lam AS MATERIALIZED (SELECT max(out) l FROM o), u AS MATERIALIZED (SELECT a.s i, b.s j, CASE WHEN a.s=b.s THEN 1-coalesce(o.out,0)/l ELSE coalesce(rate,0)/l END u FROM z a CROSS JOIN z b CROSS JOIN lam LEFT JOIN q0 ON q0.src=a.s AND q0.dst=b.s LEFT JOIN o ON o.src=a.s),
x AS (SELECT 0 k, a.s i, b.s j, (a.s=b.s)::INT::DOUBLE x FROM z a CROSS JOIN z b UNION ALL SELECT k+1, x.i, u.j, sum(x.x*u.u) FROM x JOIN u ON u.i=x.j WHERE k<{last} GROUP BY k, x.i, u.j), w AS MATERIALIZED (SELECT k, exp(-2*l+k*ln(2*l)-lgamma(k+1.0)) w FROM lam, (SELECT unnest(range(0,{last}+1)) k))"""
_END = "(SELECT floor(4+6*sqrt(2*l)+2*l)::BIGINT FROM lam)"
SQL["ctmc_future"] = f"WITH RECURSIVE {_RATES.format(last=_END)} SELECT i AS start, j AS state, round(sum(w*x),9) AS p FROM x JOIN w USING (k) GROUP BY 1,2"
_DWELL = "SELECT x.i, x.j, sum(x.x*greatest(0,1-c)/l) d FROM x JOIN (SELECT k, sum(w) OVER (ORDER BY k) c FROM w) v USING (k), lam GROUP BY 1,2"
SQL["ctmc_transitions"] = f"WITH RECURSIVE {_RATES.format(last=_END)}, y AS ({_DWELL}) SELECT y.i AS start, y.j AS src, q0.dst, round(d*rate,9) AS n FROM y JOIN q0 ON q0.src=y.j"
SQL["ctmc_dwell"] = f"WITH RECURSIVE {_RATES.format(last='199')}, y AS ({_DWELL.replace('greatest(0,1-c)', '(1-c)')}) SELECT i AS start, j AS state, round(d,6) AS time FROM y"
SQL["viterbi"] = f"""WITH RECURSIVE kinds AS (SELECT event_type e, row_number() OVER (ORDER BY event_type) i, count(*) OVER () n FROM (SELECT DISTINCT event_type FROM events)), em AS (SELECT e, ln(i/(n*(n+1)/2.0::DOUBLE)) a, ln((n-i+1)/(n*(n+1)/2.0::DOUBLE)) b FROM kinds), s AS MATERIALIZED (SELECT user_id k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) i, a, b FROM events JOIN em ON event_type=e),
v AS (SELECT k, i, {log(0.5)!r}+a va, {log(0.5)!r}+b vb, 'a' pa, 'b' pb FROM s WHERE i=1 UNION ALL SELECT s.k, s.i, greatest(va+{log(0.8)!r}, vb+{log(0.3)!r})+s.a, greatest(va+{log(0.2)!r}, vb+{log(0.7)!r})+s.b, CASE WHEN va+{log(0.8)!r}>=vb+{log(0.3)!r} THEN pa ELSE pb END||',a', CASE WHEN va+{log(0.2)!r}>=vb+{log(0.7)!r} THEN pa ELSE pb END||',b' FROM v JOIN s ON s.k=v.k AND s.i=v.i+1)
SELECT k AS key, CASE WHEN va>=vb THEN pa ELSE pb END AS path FROM v QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC)=1"""
SQL["sample_bounds"] = "SELECT 'conjunctions' AS space, ceil((ln(4*5*6)+ln(1/(1-0.95::DOUBLE)))/0.1::DOUBLE)::BIGINT AS examples UNION ALL SELECT 'disjunctions', ceil((ln(20*20)+ln(1/(1-0.95::DOUBLE)))/0.1::DOUBLE)::BIGINT"

# text

_S = f"s AS (SELECT item_id, unnest({SENT}) s, generate_subscripts({SENT}, 1)-1 pos FROM benchmark)"
SQL["sentence_scores"] = f"WITH {_S}, w AS (SELECT item_id, pos, unnest({TOK.replace('text', 's')}) term FROM s), f AS (SELECT item_id, term, count(*)::DOUBLE n FROM w GROUP BY 1,2), t AS (SELECT item_id, sum(n) t FROM f GROUP BY 1) SELECT item_id, pos::INT AS pos, round(avg(n/t),8) AS score FROM w JOIN f USING (item_id, term) JOIN t USING (item_id) GROUP BY 1,2"
_W = r"list_filter(regexp_split_to_array(lower(s), '\s+'), lambda x: x<>'')"
SQL["sumbasic"] = f"""WITH {_S}, w AS MATERIALIZED (SELECT item_id k, pos, unnest({_W}) w FROM s), p AS (SELECT k, w, count(*)*1.0::DOUBLE/sum(count(*)) OVER (PARTITION BY k) p FROM w GROUP BY 1,2), a AS MATERIALIZED (SELECT k, pos FROM (SELECT w.k, pos, sum(p)/count(*) s FROM w JOIN p ON p.k=w.k AND p.w=w.w GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(s,12) DESC, pos)=1),
q AS (SELECT p.k, p.w, CASE WHEN EXISTS (SELECT 1 FROM w JOIN a ON a.k=w.k AND a.pos=w.pos WHERE w.k=p.k AND w.w=p.w) THEN p*p ELSE p END p FROM p), b AS (SELECT k, pos FROM (SELECT w.k, w.pos, sum(p)/count(*) s FROM w JOIN q ON q.k=w.k AND q.w=w.w JOIN a ON a.k=w.k AND a.pos<>w.pos GROUP BY 1,2) QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(s,12) DESC, pos)=1)
SELECT k, 0 AS rank, pos::INT AS sentence FROM a UNION ALL SELECT k, 1, pos::INT FROM b"""
_DIST = r"list_distinct(" + _W + ")"
SQL["textrank"] = f"""WITH RECURSIVE {_S}, d AS MATERIALIZED (SELECT item_id k, pos, {_DIST} w, count(*) OVER (PARTITION BY item_id) n FROM s), m AS MATERIALIZED (SELECT a.k, a.pos i, b.pos j, a.n, CASE WHEN a.pos<>b.pos AND len(a.w)>0 AND len(b.w)>0 THEN len(list_intersect(a.w,b.w))/(ln(len(a.w)+1)+ln(len(b.w)+1)) ELSE 0 END x FROM d a JOIN d b ON a.k=b.k), p AS MATERIALIZED (SELECT k, i, j, n, x/greatest(sum(x) OVER (PARTITION BY k, i),1e-12) x FROM m),
r AS (SELECT k, pos j, 0 t, 1.0::DOUBLE/n r FROM d UNION ALL SELECT p.k, p.j, t+1, 0.15/any_value(p.n)+0.85*sum(r.r*p.x) FROM r JOIN p ON p.k=r.k AND p.i=r.j WHERE t<50 GROUP BY p.k, p.j, t)
SELECT k, (row_number() OVER (PARTITION BY k ORDER BY round(r,9) DESC, j)-1)::INT AS rank, j::INT AS sentence FROM r WHERE t=50 QUALIFY rank<2"""
SQL["mmr_summary"] = f"""WITH {_S}, w AS MATERIALIZED (SELECT item_id k, pos, unnest({_W}) w FROM s), c AS MATERIALIZED (SELECT k, pos, w, count(*)::DOUBLE c FROM w GROUP BY 1,2,3), t AS (SELECT k, w, sum(c) t FROM c GROUP BY 1,2), a AS MATERIALIZED (SELECT item_id k, s.pos, coalesce(x,0) x, coalesce(y,0) y FROM s LEFT JOIN (SELECT c.k, c.pos, sum(c*t)/greatest(1,sum(c)) x, sqrt(sum(c*c)) y FROM c JOIN t USING (k, w) GROUP BY 1,2) z ON z.k=item_id AND z.pos=s.pos),
r AS MATERIALIZED (SELECT k, pos, y, x/greatest(1e-12,max(abs(x)) OVER (PARTITION BY k)) x FROM a), f AS MATERIALIZED (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(0.7*x,12) DESC, pos)=1), g AS (SELECT r.k, r.pos, round(0.7*r.x-0.3*coalesce((SELECT sum(u.c*v.c) FROM c u JOIN c v ON u.w=v.w WHERE u.k=r.k AND u.pos=r.pos AND v.k=f.k AND v.pos=f.pos),0)/(greatest(r.y,1e-12)*greatest(f.y,1e-12)),12) s FROM r JOIN f ON f.k=r.k AND f.pos<>r.pos)
SELECT k, 0 AS rank, pos::INT AS sentence FROM f UNION ALL SELECT k, 1, pos::INT FROM g QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, pos)=1"""

# more of samples and clusters


def _epps() -> str:
    v, g = "l_extendedprice", [f"{f}(v*{t}/sg)" for f in ("cos", "sin") for t in (0.4, 0.8)]
    out = f"WITH q AS (SELECT (quantile_cont({v},0.75)-quantile_cont({v},0.25))/2 sg FROM lineitem), x AS (SELECT l_returnflag='R' f, {', '.join(f'{e} x{i}' for i, e in enumerate(g))} FROM (SELECT {v} v, l_returnflag FROM lineitem), q)"
    one = lambda f: ", ".join(["count(*)::DOUBLE n", *(f"avg(x{i}) m{i}" for i in range(4)), *(f"covar_pop(x{i},x{j}) c{i}{j}" for i in range(4) for j in range(i, 4))]) + f" FROM x WHERE {f}"
    out += f", a AS (SELECT {one('f')}), b AS (SELECT {one('NOT f')}), e0 AS (SELECT a.n+b.n n, " + ", ".join([*(f"a.m{i}-b.m{i} g{i}" for i in range(4)), *(f"(a.n+b.n)/a.n*a.c{i}{j}+(a.n+b.n)/b.n*b.c{i}{j} s{i}{j}" for i in range(4) for j in range(i, 4))]) + " FROM a, b)"
    for k in range(3):  # one column eliminated after another
        cols = ["n", *(f"g{i}" for i in range(k + 1)), *(f"s{i}{j}" for i in range(k + 1) for j in range(i, 4)), *(f"g{i}-s{k}{i}/s{k}{k}*g{k} AS g{i}" for i in range(k + 1, 4)), *(f"s{i}{j}-s{k}{i}/s{k}{k}*s{k}{j} AS s{i}{j}" for i in range(k + 1, 4) for j in range(i, 4))]
        out += f", e{k + 1} AS (SELECT {', '.join(cols)} FROM e{k})"
    return out + ", w AS (SELECT n*(" + "+".join(f"g{i}*g{i}/s{i}{i}" for i in range(4)) + ") w FROM e3) SELECT round(w,6) AS w, round(exp(-w/2)*(1+w/2),6) AS p FROM w"


SQL["epps_singleton"] = _epps()
_RNG = np.random.default_rng(1)
_at = 0.2 + 0.6 * float(_RNG.random())
_n = int(_RNG.integers(1, 3))
_some = ",".join(f"'{'FOP'[i]}'" for i in sorted(_RNG.choice(3, _n, replace=False)))
SQL["random_partitions"] = f"WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders), p AS (SELECT o_totalprice>=lo+(hi-lo)*{_at!r} h, o_orderstatus NOT IN ({_some}) s FROM orders, r) SELECT (h::INT*2+s::INT)::INT AS part, count(*) AS n FROM p GROUP BY 1"


def _knee(rounds: int) -> str:
    out = f"WITH p AS MATERIALIZED (SELECT p_partkey k, p_size/50.0::DOUBLE a, p_retailprice/2000 b FROM part), z AS (SELECT unnest([2,3,4,5]) z), o AS (SELECT 0 s, a, b, row_number() OVER (ORDER BY {uniform(1, 'k')})-1 i FROM p UNION ALL SELECT 1, a, b, row_number() OVER (ORDER BY {uniform(2, 'k')})-1 FROM p), c0 AS MATERIALIZED (SELECT z, s, i, a, b FROM o JOIN z ON i<z)"
    for r in range(rounds):
        out += f", n{r} AS MATERIALIZED (SELECT c.z, c.s, p.k, p.a, p.b, c.i, (p.a-c.a)^2+(p.b-c.b)^2 d FROM p, c{r} c QUALIFY row_number() OVER (PARTITION BY c.z, c.s, p.k ORDER BY d, c.i)=1), m{r} AS (SELECT z, s, i, avg(a) a, avg(b) b FROM n{r} GROUP BY 1,2,3), c{r + 1} AS MATERIALIZED (SELECT c.z, c.s, c.i, coalesce(m.a,c.a) a, coalesce(m.b,c.b) b FROM c{r} c LEFT JOIN m{r} m ON m.z=c.z AND m.s=c.s AND m.i=c.i)"
    return out + f", e AS (SELECT z, min(e) e FROM (SELECT z, s, sum(d) e FROM n{rounds - 1} GROUP BY 1,2) GROUP BY 1), g AS (SELECT z, e, lag(e) OVER (ORDER BY z)-2*e+lead(e) OVER (ORDER BY z) g FROM e) SELECT z AS k, round(e,6) AS sse, coalesce(g=(SELECT max(g) FROM g),false) AS knee FROM g"


SQL["kmeans_knee"] = _knee(4)


def _least_squares() -> str:
    x = ["l_quantity", "l_discount", "l_tax"]
    one = ", ".join([f"avg({c}) m{i}" for i, c in enumerate(x)] + ["avg(l_extendedprice) my"] + [f"covar_pop({x[i]},{x[j]}) s{i}{j}" for i in range(3) for j in range(i, 3)] + [f"covar_pop({c},l_extendedprice) g{i}" for i, c in enumerate(x)])
    out = f"WITH e0 AS (SELECT {one} FROM lineitem)"
    for k in range(2):
        keep = ["m0", "m1", "m2", "my", *(f"g{i}" for i in range(k + 1)), *(f"s{i}{j}" for i in range(k + 1) for j in range(i, 3))]
        out += f", e{k + 1} AS (SELECT {', '.join(keep)}, " + ", ".join([*(f"g{i}-s{k}{i}/s{k}{k}*g{k} AS g{i}" for i in range(k + 1, 3)), *(f"s{i}{j}-s{k}{i}/s{k}{k}*s{k}{j} AS s{i}{j}" for i in range(k + 1, 3) for j in range(i, 3))]) + f" FROM e{k})"
    out += ", b2 AS (SELECT *, g2/s22 b2 FROM e2), b1 AS (SELECT *, (g1-s12*b2)/s11 b1 FROM b2), b AS (SELECT *, (g0-s01*b1-s02*b2)/s00 b0 FROM b1), f AS (SELECT l_extendedprice y, my+b0*(l_quantity-m0)+b1*(l_discount-m1)+b2*(l_tax-m2) p FROM lineitem, b)"
    return out + " SELECT round(1-avg((y-p)^2)/var_pop(y),4) AS r2, round(avg(abs(y-p)),4) AS mae, round(avg((y-p)^2),4) AS mse FROM f"


SQL["regress_linear"] = _least_squares()
_x3 = ("l_quantity", "l_discount", "l_tax")
SQL["classify_naive_bayes"] = f"""WITH e AS (SELECT 1e-9*greatest({', '.join(f'var_pop({c})' for c in _x3)}) e FROM lineitem), g AS (SELECT (l_returnflag='R')::INT y, ln(count(*)*1.0::DOUBLE/(SELECT count(*) FROM lineitem)) p, {', '.join(f'avg({c}) m{i}, var_pop({c}) v{i}' for i, c in enumerate(_x3))} FROM lineitem GROUP BY 1),
s AS (SELECT i, (l_returnflag='R')::INT t, g.y, p-({'+'.join(f'({c}-m{i})^2/(2*(v{i}+e))+ln(2*pi()*(v{i}+e))/2' for i, c in enumerate(_x3))}) s FROM (SELECT *, row_number() OVER () i FROM lineitem), g, e), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY s DESC)=1)
SELECT y::DOUBLE AS prediction, count(*) AS n, round(avg(t),6) AS share FROM b GROUP BY 1"""


def _robust(rounds: int) -> str:
    cov = "avg(s) a, avg(r) b, var_samp(s) va, var_samp(r) vb, covar_samp(s,r) c"
    d = "sqrt(greatest(0,((s-a)^2*vb-2*(s-a)*(r-b)*c+(r-b)^2*va)/(va*vb-c*c)))"
    out = f"WITH p AS MATERIALIZED (SELECT p_partkey k, p_size::DOUBLE s, p_retailprice r FROM part), m0 AS (SELECT {cov}, false done FROM p)"
    for i in range(rounds):
        out += f", d{i} AS (SELECT s, r, {d} d FROM p, m{i}), n{i} AS (SELECT {cov} FROM d{i} WHERE d<=(SELECT quantile_disc(d,0.75) FROM d{i})), m{i + 1} AS MATERIALIZED (SELECT CASE WHEN m.done THEN m.a ELSE n.a END a, CASE WHEN m.done THEN m.b ELSE n.b END b, CASE WHEN m.done THEN m.va ELSE n.va END va, CASE WHEN m.done THEN m.vb ELSE n.vb END vb, CASE WHEN m.done THEN m.c ELSE n.c END c, m.done OR (abs(n.a-m.a)<=1e-8+1e-6*abs(m.a) AND abs(n.b-m.b)<=1e-8+1e-6*abs(m.b)) done FROM m{i} m, n{i} n)"
    return out + f" SELECT k AS p_partkey, round({d},6) AS distance FROM p, m{rounds}"


SQL["robust_mahalanobis"] = _robust(10)
SQL["spirit"] = """WITH RECURSIVE s AS MATERIALIZED (SELECT user_id u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) t, value x, hour(ts)::DOUBLE y FROM events),
r AS (SELECT DISTINCT u, 0::BIGINT t, 1.0::DOUBLE a0, 0.0::DOUBLE a1, 0.0::DOUBLE b0, 1.0::DOUBLE b1, 1e-3::DOUBLE d0, 1e-3::DOUBLE d1, 1 k, 1 nk, 0.0::DOUBLE e, 0.0::DOUBLE p0, 0.0::DOUBLE p1, 0.0::DOUBLE share FROM s
UNION ALL SELECT u, t, a0, a1, b0, b1, d0, d1, k, CASE WHEN share<0.95 AND k<2 THEN 2 WHEN k>1 AND p0>0.98*e THEN 1 ELSE k END, e, p0, p1, share FROM (
SELECT *, CASE WHEN e=0 THEN 1.0 ELSE (p0+CASE WHEN k>1 THEN p1 ELSE 0 END)/e END share FROM (
SELECT u, t, a0, a1, CASE WHEN k>1 THEN b0+y1/d1*(q0-y1*b0) ELSE b0 END b0, CASE WHEN k>1 THEN b1+y1/d1*(q1-y1*b1) ELSE b1 END b1, d0, d1, k, (0.96*(t-1)*e+x*x+y*y)/t e, (0.96*(t-1)*p0+y0*y0)/t p0, CASE WHEN k>1 THEN (0.96*(t-1)*p1+y1*y1)/t ELSE p1 END p1 FROM (
SELECT *, CASE WHEN k>1 THEN 0.96*d1z+y1*y1 ELSE d1z END d1 FROM (
SELECT *, CASE WHEN k>1 THEN b0*q0+b1*q1 ELSE 0 END y1 FROM (
SELECT *, x-y0*a0 q0, y-y0*a1 q1 FROM (
SELECT u, t, x, y, k, e, p0, p1, b0, b1, d1z, y0, d0, a0z+y0/d0*(x-y0*a0z) a0, a1z+y0/d0*(y-y0*a1z) a1 FROM (
SELECT *, 0.96*d0z+y0*y0 d0 FROM (
SELECT s.u, s.t, s.x, s.y, r.nk k, r.e, r.p0, r.p1, r.a0 a0z, r.a1 a1z, r.b0, r.b1, r.d0 d0z, r.d1 d1z, r.a0*s.x+r.a1*s.y y0 FROM r JOIN s ON s.u=r.u AND s.t=r.t+1)))))))))
SELECT u AS k, t-1 AS t, k::BIGINT AS hidden, round(share,6) AS energy FROM r WHERE t>0"""
