from pyspark.sql import functions as F

from ..operators import describe as d
from ..operators.contingency import rounded
from ..operators.ordered import quantiles
from . import query

LI = "lineitem"


@query("""WITH m AS (SELECT avg(value) m, median(value) md FROM events)
SELECT count(value) AS n, round(min(value),6) AS min, round(max(value),6) AS max, round(any_value(m),6) AS mean, round(any_value(md),6) AS median,
round(sqrt(avg((value-m)^2)),6) AS std_pop, round(avg((value-m)^3)/pow(avg((value-m)^2),1.5),6) AS skewness, round(avg((value-m)^4)/pow(avg((value-m)^2),2)-3,6) AS kurtosis, round(median(abs(value-md))*1.4826,6) AS mad FROM events, m""")
def num_stats(read):
    return d.num_stats(read("events"), "value")


@query("""(SELECT o_orderkey, o_totalprice, 'low' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10)
UNION ALL (SELECT o_orderkey, o_totalprice, 'high' AS side FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)""")
def num_extremes(read):
    return d.extremes(read("orders"), "o_totalprice", "o_orderkey", 10)


@query("""WITH c AS (SELECT o_orderpriority v, count(*) k FROM orders GROUP BY 1), t AS (SELECT sum(k)::BIGINT n, count(*) u FROM c)
SELECT n, u AS n_unique, (SELECT v FROM c ORDER BY k DESC, v DESC LIMIT 1) AS mode, (SELECT max(k) FROM c) AS mode_count, (SELECT round(sum(-(k*1.0/t.n)*ln(k*1.0/t.n)),6) FROM c, t) AS entropy FROM t""")
def cat_stats(read):
    return d.cat_stats(read("orders"), "o_orderpriority")


@query("""SELECT 'ts' AS "column", count(*) - count(ts) AS nulls, round((count(*)-count(ts))*1.0/count(*),6) AS fraction FROM events
UNION ALL SELECT 'value', count(*) - count(value), round((count(*)-count(value))*1.0/count(*),6) FROM events
UNION ALL SELECT 'props', count(*) - count(props), round((count(*)-count(props))*1.0/count(*),6) FROM events""")
def null_counts(read):
    return d.null_counts(read("events"), ["ts", "value", "props"])


@query("""SELECT * FROM (VALUES ('user_id','integer'),('event_type','categorical'),('value','float')) t("column", type)""")
def type_profile(read):
    return d.type_profile(read("events"), ["user_id", "event_type", "value"])


HIST = """r AS (SELECT min(value) lo, max(value) hi, count(*) n FROM events), s AS (SELECT lo - (hi-lo)/(2*19) lo, (hi-lo+2*((hi-lo)/(2*19)))/20 w, n FROM r),
h AS (SELECT least(floor((value-lo)/w),19)::INT AS bin, count(*) c, any_value(n) n FROM events, s GROUP BY 1)"""


@query(f"WITH {HIST} SELECT bin, c AS count, round(c*1.0/n,6) AS freq FROM h")
def rel_freq(read):
    return d.histogram(read("events"), "value", 20).select("bin", "count", F.round("freq", 6).alias("freq"))


@query(f"WITH {HIST} SELECT bin, (sum(c) OVER (ORDER BY bin))::BIGINT AS cum_count FROM h")
def cum_freq(read):
    return d.cumulative(d.histogram(read("events"), "value", 20))


@query("SELECT round(50.0*(sum((value<100)::INT)+sum((value<=100)::INT)+CASE WHEN sum((value<=100)::INT)>sum((value<100)::INT) THEN 1 ELSE 0 END)/count(value),6) AS percentile FROM events")
def percentile_of(read):
    return d.percentile_of(read("events"), "value", 100.0)


@query("SELECT round(quantile_cont(o_totalprice,0.9),4) AS p90, round(quantile_cont(o_totalprice,0.25),4) AS p25 FROM orders")
def value_at_percentile(read):
    return rounded(quantiles(read("orders"), "o_totalprice", {"p90": 0.9, "p25": 0.25}), 4)


@query("""SELECT round(50.0*(sum((value<200)::INT)+sum((value<=200)::INT)+CASE WHEN sum((value<=200)::INT)>sum((value<200)::INT) THEN 1 ELSE 0 END)/count(value)
- 50.0*(sum((value<50)::INT)+sum((value<=50)::INT)+CASE WHEN sum((value<=50)::INT)>sum((value<50)::INT) THEN 1 ELSE 0 END)/count(value),6) AS range_percentile FROM events""")
def range_percentile(read):
    e = read("events")
    a, b = d.percentile_of(e, "value", 50.0), d.percentile_of(e, "value", 200.0)
    return a.withColumnRenamed("percentile", "a").crossJoin(b).select(F.round(F.col("percentile") - F.col("a"), 6).alias("range_percentile"))


@query("SELECT event_id, value FROM events WHERE value < 5")
def less_than(read):
    return read("events").where("value < 5").select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value > 200")
def greater_than(read):
    return read("events").where("value > 200").select("event_id", "value")


@query("SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def unique_counts(read):
    return read(LI).groupBy("l_quantity").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def cat_unique_counts(read):
    return read("part").groupBy("p_type").agg(F.count("*").alias("n"))


@query(r"""SELECT count_if(regexp_full_match(p_name,'[A-Za-z]+')) AS alpha, count_if(regexp_full_match(p_name,'[0-9]+')) AS num, count_if(regexp_full_match(p_name,'[A-Za-z0-9]+')) AS alphanum FROM part""")
def char_class_counts(read):
    c = F.col("p_name")
    return read("part").agg(F.count_if(c.rlike("^[A-Za-z]+$")).alias("alpha"), F.count_if(c.rlike("^[0-9]+$")).alias("num"), F.count_if(c.rlike("^[A-Za-z0-9]+$")).alias("alphanum"))


CH = "WITH t AS (SELECT len(regexp_extract_all(p_name,'[A-Za-z]')) a, len(regexp_extract_all(p_name,'[0-9]')) n, len(regexp_extract_all(p_name,'[^A-Za-z0-9\\s]')) s FROM part) SELECT "
CH += ", ".join(f"round(avg({k}),6) AS {p}_mean, round(stddev_pop({k}),6) AS {p}_std, max({k})::BIGINT AS {p}_max, min({k})::BIGINT AS {p}_min" for k, p in (("a", "alpha"), ("n", "num"), ("s", "special"))) + " FROM t"


@query(CH)
def char_count_stats(read):
    p = read("part").select(*d.char_counts(read("part"), "p_name"))
    return p.agg(*(x for c in ("alpha", "num", "special") for x in d.stats_of(p, F.col(c), c)))


@query("SELECT round(avg(length(c_name)),6) AS len_mean, round(stddev_pop(length(c_name)),6) AS len_std, max(length(c_name)) AS len_max, min(length(c_name)) AS len_min, round(avg(length(c_name)-length(replace(c_name,'0',''))),6) AS zero_mean FROM customer")
def field_len_stats(read):
    c = read("customer")
    n = F.length("c_name").cast("long")
    return c.agg(*d.stats_of(c, n, "len"), F.round(F.avg(F.length("c_name") - F.length(F.replace("c_name", F.lit("0"), F.lit("")))), 6).alias("zero_mean"))


@query("""WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) d FROM events)
SELECT user_id, coalesce(min(d)>=0,true) AS increasing, coalesce(max(d)<=0,true) AS decreasing FROM d GROUP BY 1""")
def monotonic_check(read):
    return d.monotonic(read("events"), "user_id", ["ts", "event_id"], "value")


@query("""SELECT least(floor(l_quantity/10),4)::INT AS bin, count(*) AS n, round(avg(l_discount),6) AS mean_discount FROM lineitem GROUP BY 1""")
def group_by_binned(read):
    return read(LI).groupBy(F.least(F.floor(F.col("l_quantity") / 10), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_discount"))
