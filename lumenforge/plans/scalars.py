from pyspark.sql import functions as F

from ..operators import scalars as x
from . import query

SEC = "epoch_us(ts)//1000000"


def _sec():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)


@query("SELECT event_id, CASE WHEN regexp_full_match(v,'[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v,'[+-]?[0-9]*\\.[0-9]*') THEN 'float' ELSE 'string' END AS kind, regexp_full_match(v,'[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') AS number FROM (SELECT event_id, CASE WHEN user_id<20 THEN user_id::VARCHAR WHEN user_id<60 THEN printf('%.2f', value) ELSE event_type END v FROM events)")
def typed_parse(read):
    v = F.when(F.col("user_id") < 20, F.col("user_id").cast("string")).when(F.col("user_id") < 60, F.format_string("%.2f", "value")).otherwise(F.col("event_type"))
    return read("events").select("event_id", x.kind_of(v).alias("kind"), x.is_number(v).alias("number"))


@query("SELECT c_custkey, split_part(c_name,'#',1) AS head, CASE WHEN contains(c_name,'#') THEN split_part(c_name,'#',2) END AS tail, substr(c_name,4,greatest(0,length(c_name)-6)) AS inner_part, printf('%.2f', c_acctbal) AS shown FROM customer")
def string_parts(read):
    head, tail = x.split_once(F.col("c_name"), "#")
    return read("customer").select("c_custkey", head.alias("head"), tail.alias("tail"), x.trimmed(F.col("c_name"), 3).alias("inner_part"), x.formatted(F.col("c_acctbal"), 2).alias("shown"))


@query()
def mutate_strings(read):
    return read("customer").select("c_custkey", x.mutated(F.col("c_name"), 2).alias("name"))


@query(f"SELECT event_id, {SEC}//60*60 AS minute, {SEC}//300*300 AS five, {SEC}//3600*3600 AS hour, {SEC}//86400*86400 AS day, ({SEC}-9*3600)//86400*86400+9*3600 AS nine FROM events")
def time_alignment(read):
    s = _sec()
    cols = {"minute": x.aligned(s, 60), "five": x.aligned(s, 300), "hour": x.aligned(s, 3600), "day": x.aligned(s, 86400), "nine": x.hour_anchor(s, 9)}
    return read("events").select("event_id", *(c.cast("long").alias(k) for k, c in cols.items()))


@query(f"SELECT event_id, ({SEC}%604800//86400)::INT AS day_of_week, ({SEC}%86400//3600)::INT AS hour_of_day, floor(({SEC}%31536000)/2628000.0)::INT AS month_of_year FROM events")
def calendar_parts(read):
    s = _sec()
    return read("events").select("event_id", x.day_of_week(s).alias("day_of_week"), x.hour_of_day(s).alias("hour_of_day"), x.month_of_year(s).alias("month_of_year"))


@query("SELECT l_orderkey, round(sum(l_quantity*l_linenumber)/sum(l_linenumber),6) AS weighted FROM lineitem GROUP BY 1")
def weighted_average(read):
    a = read("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_linenumber")).alias("r"))
    return a.select("l_orderkey", F.round(x.weighted_average(F.transform("r", lambda r: r["l_quantity"]), F.transform("r", lambda r: r["l_linenumber"])), 6).alias("weighted"))


@query("SELECT s_suppkey, round((s_acctbal-2*s_suppkey+s_nationkey)/2,6) AS a, round(s_suppkey-s_acctbal-(s_acctbal-2*s_suppkey+s_nationkey)/2,6) AS b, round(s_acctbal,6) AS c FROM supplier")
def parabola_fit(read):
    a, b, c = x.parabola((0.0, 1.0, 2.0), (F.col("s_acctbal"), F.col("s_suppkey"), F.col("s_nationkey")))
    return read("supplier").select("s_suppkey", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(c, 6).alias("c"))


@query("SELECT p_partkey, round((SELECT sum(1.0/i::DOUBLE) FROM range(1, p_size+1) t(i)),9) AS harmonic, round(coalesce((SELECT sum(1.0/i::DOUBLE) FROM range(1, p_size) t(i)),0)-0.577216,9) AS digamma FROM part")
def harmonic_numbers(read):
    return read("part").select("p_partkey", F.round(x.harmonic(F.col("p_size")), 9).alias("harmonic"), F.round(x.digamma(F.col("p_size")), 9).alias("digamma"))


@query("SELECT vec_id, round(pow(list_sum(list_transform(embedding, lambda v: pow(abs(v::DOUBLE),3))),1/3.0::DOUBLE),6) AS size3, round(list_max(list_transform(embedding, lambda v: v::DOUBLE))/sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE*v::DOUBLE))),6) AS top FROM embeddings")
def vector_norms(read):
    e = F.transform("embedding", lambda v: v.cast("double"))
    zero = F.transform("embedding", lambda v: F.lit(0.0))
    return read("embeddings").select("vec_id", F.round(x.minkowski(e, zero, 3.0), 6).alias("size3"), F.round(F.array_max(x.norm(e)), 6).alias("top"))


@query("SELECT c_custkey, array_to_string(list_transform(range(0,25), lambda i: (i=c_nationkey)::INT),'') AS hot, lpad(bin(c_nationkey::BIGINT),5,'0') AS code FROM customer")
def one_hot_codes(read):
    join = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), "")
    return read("customer").select("c_custkey", join(x.one_hot(F.col("c_nationkey"), 25)).alias("hot"), join(x.binary_code(F.col("c_nationkey"), 5)).alias("code"))


@query("SELECT o_orderkey, floor((o_totalprice-1000)/5000)::INT AS bin FROM orders")
def binning(read):
    return read("orders").select("o_orderkey", x.binned(F.col("o_totalprice"), 1000.0, 5000.0).alias("bin"))


@query("WITH a AS (SELECT l_orderkey k, l_linenumber i, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity)-1 r, l_quantity q, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) p FROM lineitem) SELECT k, string_agg(r::VARCHAR, ',' ORDER BY i, q) AS ranks, max(q-p) AS gap FROM a GROUP BY 1")
def array_ranks(read):
    a = read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda r: r["l_quantity"]).alias("v"))
    return a.select("k", F.array_join(F.transform(x.ranks(F.col("v")), lambda r: r.cast("string")), ",").alias("ranks"), x.greatest_gap(F.col("v")).alias("gap"))


@query("SELECT n_nationkey, array_to_string(list_concat([n_nationkey], range(n_nationkey+2, n_nationkey+5)), ',') AS numbers FROM nation")
def range_strings(read):
    n = F.col("n_nationkey")
    text = F.concat_ws("", n.cast("string"), F.lit(","), (n + 2).cast("string"), F.lit(":"), (n + 4).cast("string"))
    return read("nation").select("n_nationkey", F.array_join(F.transform(x.int_ranges(text), lambda v: v.cast("string")), ",").alias("numbers"))


@query("SELECT user_id, count_if(event_type='click')::INT AS clicks, count(*)::INT AS n FROM events GROUP BY 1")
def keyed_counters(read):
    m = F.create_map(F.lit("n"), F.lit(0), F.lit("click"), F.lit(0))
    s = read("events").groupBy("user_id").agg(F.aggregate(F.collect_list("event_type"), m, lambda a, e: x.add_to_map(x.add_to_map(a, F.lit("n"), F.lit(1)), F.when(e == "click", e).otherwise(F.lit("other")), F.lit(1))).alias("m"))
    return s.select("user_id", F.col("m")["click"].alias("clicks"), F.col("m")["n"].alias("n"))


@query("SELECT vec_id, (i-1)//16 AS part, round(sum(embedding[i]::DOUBLE),5) AS total FROM (SELECT vec_id, embedding, unnest(range(1,len(embedding)+1)) i FROM embeddings) GROUP BY 1,2")
def matrix_rows(read):
    """Vectors of n x k numbers as n rows of k."""
    p = read("embeddings").select("vec_id", F.posexplode(x.chunks(F.col("embedding"), 16)).alias("part", "v"))
    return p.select("vec_id", F.col("part").cast("long").alias("part"), F.round(F.aggregate("v", F.lit(0.0), lambda s, y: s + y), 5).alias("total"))


@query(f"SELECT event_id, {SEC}-3*86400 AS begin, {SEC} AS end_ FROM events")
def past_intervals(read):
    """The three days before each event."""
    p = x.past_interval(_sec(), 3, "d")
    return read("events").select("event_id", p["begin"].alias("begin"), p["end"].alias("end_"))
