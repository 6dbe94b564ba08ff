from pyspark.sql import functions as F

from ..operators import association as a
from ..operators.contingency import rounded
from . import query

B = "b AS (SELECT DISTINCT l_orderkey t, p_brand i FROM lineitem JOIN part ON l_partkey=p_partkey), n AS (SELECT count(DISTINCT t) n FROM b), f1 AS (SELECT i, count(*) c FROM b GROUP BY 1 HAVING count(*) > 0.02*(SELECT n FROM n))"
F2 = "f2 AS (SELECT x.i i1, y.i i2, count(*) c FROM b x JOIN b y ON x.t=y.t AND x.i<y.i GROUP BY 1,2 HAVING count(*) > 0.02*(SELECT n FROM n))"


def _items(read):
    return read("lineitem").select("l_orderkey", "l_partkey").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item"))


def _b(read):
    return _items(read).distinct()


@query(f"WITH {B} SELECT i AS i1, c AS n, round(c*1.0/n,6) AS support FROM f1, n")
def freq_items_1(read):
    return rounded(a.frequent(_b(read), 1, 0.02))


@query(f"WITH {B}, {F2} SELECT i1, i2, c AS n, round(c*1.0/n,6) AS support FROM f2, n")
def freq_items_2(read):
    return rounded(a.frequent(_b(read), 2, 0.02))


@query(f"WITH {B} SELECT x.i AS i1, y.i AS i2, z.i AS i3, count(*) AS n, round(count(*)*1.0/any_value(n),6) AS support FROM b x JOIN b y ON x.t=y.t AND x.i<y.i JOIN b z ON x.t=z.t AND y.i<z.i, n GROUP BY 1,2,3 HAVING count(*) > 0.002*any_value(n)")
def freq_items_3(read):
    return rounded(a.frequent(_b(read), 3, 0.002))


@query(f"WITH {B}, {F2}, r AS (SELECT i1 ante, i2 cons, c FROM f2 UNION ALL SELECT i2, i1, c FROM f2) SELECT ante, cons, round(r.c*1.0/n,6) AS support, round(r.c*1.0/f1.c,6) AS confidence FROM r JOIN f1 ON ante=i, n WHERE r.c*1.0/f1.c > 0.15")
def assoc_rules(read):
    b = _b(read)
    return rounded(a.rules(a.frequent(b, 2, 0.02), a.frequent(b, 1, 0.02), 0.15))


@query("WITH b AS (SELECT DISTINCT l_orderkey t, p_type i FROM lineitem JOIN part ON l_partkey=p_partkey), n AS (SELECT count(DISTINCT t) n FROM b), f AS (SELECT i FROM b GROUP BY 1 HAVING count(*) > 0.5*(SELECT n FROM n)) SELECT t AS tid, CASE WHEN f.i IS NULL THEN '*' ELSE b.i END AS item FROM b LEFT JOIN f ON b.i=f.i")
def infrequent_mark(read):
    b = read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), F.col("p_type").alias("item")).distinct()
    return a.mark_infrequent(b, a.frequent(b, 1, 0.5), "*")


def _sets(most: int, support: str, key: str = "") -> str:
    """Item sets of up to so many items: k (the partition), s (items by commas), c, n."""
    k = key or "0"
    out = f"b AS MATERIALIZED (SELECT DISTINCT {k} k, l_orderkey t, p_brand i FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey), n AS (SELECT k, count(DISTINCT t) n FROM b GROUP BY 1)"
    for level in range(1, most + 1):
        names = [f"b{j}" for j in range(level)]
        joins = "".join(f" JOIN b {x} ON {x}.k=b0.k AND {x}.t=b0.t AND {y}.i<{x}.i" for y, x in zip(names, names[1:]))
        items = ", ".join(f"{x}.i" for x in names)
        out += f", s{level} AS (SELECT b0.k, array_to_string([{items}],',') s, [{items}] a, count(*) c, any_value(n) n FROM b b0{joins} JOIN n ON n.k=b0.k GROUP BY ALL HAVING count(*) > {support}*any_value(n))"
    return out + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM s{level}" for level in range(1, most + 1)) + ")"


def _keyed(read):
    o = read("orders").select("o_orderkey", "o_orderpriority")
    x = read("lineitem").select("l_orderkey", "l_partkey").join(read("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.select(F.col("o_orderpriority").alias("k"), F.col("l_orderkey").alias("tid"), F.col("p_brand").alias("item"))


_RULES = """, m AS (SELECT *, unnest(range(1, (1<<len(a))-1)) z FROM u WHERE len(a)>1), r AS (SELECT k, c, n, list_filter(a, lambda x, i: (z>>(i-1))&1=1) p, list_filter(a, lambda x, i: (z>>(i-1))&1=0) q FROM m)
SELECT {key}array_to_string(p,',') AS ante, array_to_string(q,',') AS cons, round(r.c*1.0/r.n,6) AS support, round(r.c*1.0/u.c,6) AS confidence FROM r JOIN u ON u.k=r.k AND u.a=p WHERE len(p)<=3 AND r.c*1.0/u.c > {least}"""


def _shown(rules):
    return rounded(rules.withColumns({c: F.array_join(c, ",") for c in ("ante", "cons")}))


@query(f"WITH {_sets(4, '0.0002')}" + _RULES.format(key="", least="0.1"))
def assoc_rules_of_three(read):
    """Antecedents of one to three items."""
    return _shown(a.set_rules(a.item_sets(_items(read), 4, 0.0002), 3, 0.1))


@query(f"WITH {_sets(3, '0.004', 'o_orderpriority')} SELECT k, s AS items, c AS n, round(c*1.0/n,6) AS support FROM u")
def freq_items_by_key(read):
    """Of each order priority by itself."""
    return rounded(a.item_sets(_keyed(read), 3, 0.004, ["k"]).withColumn("items", F.array_join("items", ",")))


@query(f"WITH {_sets(3, '0.004', 'o_orderpriority')}" + _RULES.format(key="r.k, ", least="0.12"))
def assoc_rules_by_key(read):
    return _shown(a.set_rules(a.item_sets(_keyed(read), 3, 0.004, ["k"]), 3, 0.12, ["k"]))
