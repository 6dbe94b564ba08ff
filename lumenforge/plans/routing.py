from pyspark.sql import functions as F

from ..operators import routing as r
from . import query

KEY = ["l_orderkey", "l_linenumber"]


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def project_ordinals(read):
    return r.project(read("orders"), [0, 3, 2])


@query("SELECT r_name FROM region")
def drop_ordinals(read):
    return r.drop(read("region").select("r_regionkey", "r_name"), [0])


@query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 40 AND l_returnflag IN ('A','R')")
def filtered_scan(read):
    return read("lineitem").where(r.conjunction("l_quantity gt 10 40 and l_returnflag in A:R")).select(*KEY, "l_tax")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity>=10 AND l_quantity<20 AND l_linestatus='F' THEN 'low' WHEN l_discount<=0.05 AND l_discount>0.01 THEN 'mid' ELSE 'rest' END AS cls FROM lineitem""")
def rule_classes(read):
    return read("lineitem").select(*KEY, r.first_match(["l_quantity ge 10 20 and l_linestatus eq F => low", "l_discount le 0.05 0.01 => mid"], "rest").alias("cls"))


@query("SELECT l_orderkey, l_linenumber, ((l_quantity>10)::INT+(l_quantity>20)::INT+(l_quantity>35)::INT)::INT AS segment, CASE WHEN l_returnflag IN ('A','N') THEN 0 WHEN l_returnflag='R' THEN 1 END AS grp FROM lineitem")
def split_segments(read):
    return read("lineitem").select(*KEY, r.segment_of(F.col("l_quantity"), [10, 20, 35]).alias("segment"), r.group_of(F.col("l_returnflag"), [["A", "N"], ["R"]]).alias("grp"))


@query("SELECT CASE WHEN o_totalprice<250000 AND o_orderstatus='F' THEN 0 WHEN o_totalprice<250000 THEN 1 WHEN o_orderstatus='F' THEN 2 ELSE 3 END AS part, count(*) AS n, round(avg(o_totalprice),4) AS mean FROM orders GROUP BY 1")
def predicate_partitions(read):
    p = r.partitions(read("orders"), [[r.predicate("o_totalprice lt 250000"), r.predicate("o_totalprice ge 250000")], [r.predicate("o_orderstatus in F"), r.predicate("o_orderstatus notin F")]])
    return p.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query()
def random_partitions(read):
    o = read("orders")
    return r.partitions(o, r.random_halves(o, ["o_totalprice"], {"o_orderstatus": ["F", "O", "P"]})).groupBy("part").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, round((s_acctbal+100)*1.5,6) AS s_acctbal FROM supplier")
def shift_scale(read):
    return r.shift_scale(read("supplier").select("s_suppkey", "s_acctbal"), {"s_acctbal": (100.0, 1.5)}).select("s_suppkey", F.round("s_acctbal", 6).alias("s_acctbal"))


@query("""SELECT s_suppkey, s_nationkey::INT AS s_nationkey, s_acctbal, 'R' AS kind FROM supplier UNION ALL SELECT s_suppkey, n::INT, b, 'G' FROM supplier, (SELECT unnest([1,5]) n), (SELECT unnest([0.0,500.0,1000.0])::DOUBLE b)""")
def candidate_grid(read):
    s = read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return r.candidate_grid(s, {"s_nationkey": [1, 5], "s_acctbal": [0.0, 500.0, 1000.0]})


@query("SELECT o_orderkey, round(abs(o_totalprice-200000)*0.01 + CASE WHEN o_orderstatus='O' THEN 5.0 WHEN o_orderstatus='P' THEN 2.5 ELSE 0 END,4) AS cost FROM orders")
def change_cost(read):
    o = read("orders").select("o_orderkey", F.struct("o_totalprice", "o_orderstatus").alias("a"), F.struct(F.lit(200000.0).alias("o_totalprice"), F.lit("F").alias("o_orderstatus")).alias("b"))
    return o.select("o_orderkey", F.round(r.change_cost(o, "b", "a", {"o_totalprice": 0.01}, {"o_orderstatus": {("O", "F"): 5.0, ("P", "F"): 2.5}}), 4).alias("cost"))


@query("""WITH u AS (SELECT c_nationkey k FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT k, count(*) AS n FROM u GROUP BY 1""")
def union_all(read):
    u = read("customer").select(F.col("c_nationkey").alias("k")).unionAll(read("supplier").select("s_nationkey"))
    return u.groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus='F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def except_keys(read):
    o = read("orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus='F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus='P'")
def intersect_keys(read):
    o = read("orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("""WITH s AS (SELECT l_orderkey k, list_sort(list(DISTINCT l_linestatus || l_returnflag)) i FROM lineitem GROUP BY 1), x AS (SELECT k, i, unnest(range(1,len(i)+1)) a FROM s), y AS (SELECT k, i, a, unnest(range(a+1,len(i)+1)) b FROM x)
SELECT sub, count(*) AS n FROM (SELECT i[a] sub FROM x UNION ALL SELECT i[a]||','||i[b] FROM y) GROUP BY 1""")
def power_subsets(read):
    s = read("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_linestatus", "l_returnflag"))).alias("i"))
    return s.select(F.explode(r.sublists(F.col("i"), 2)).alias("s")).groupBy(F.concat_ws(",", "s").alias("sub")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_custkey k, list_sort(list(DISTINCT o_orderstatus)) a, list_sort(list(DISTINCT substr(o_orderpriority,1,1))) b FROM orders GROUP BY 1), t AS (SELECT c_custkey k, [substr(c_mktsegment,1,1), 'F', 'O'] c FROM customer)
SELECT s.k, len(list_intersect(a, c)) AS both, len(a) - len(list_intersect(a, c)) AS only_left, len(list_distinct(c)) - len(list_intersect(a, c)) AS only_right FROM s JOIN t ON s.k=t.k""")
def set_pieces(read):
    s = read("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set("o_orderstatus").alias("a"))
    t = read("customer").select(F.col("c_custkey").alias("k"), F.array(F.substring("c_mktsegment", 1, 1), F.lit("F"), F.lit("O")).alias("c"))
    j = s.join(t, "k")
    size = lambda c: F.size(c).cast("long")
    return j.select("k", size(F.array_intersect("a", "c")).alias("both"), size(F.array_except("a", "c")).alias("only_left"), size(F.array_except("c", "a")).alias("only_right"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus),(o_orderpriority),(o_orderstatus,o_orderpriority),())")
def grouping_sets(read):
    c = read("orders").cube("o_orderstatus", "o_orderpriority")
    return c.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
