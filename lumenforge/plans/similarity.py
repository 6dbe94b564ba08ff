from pyspark.sql import functions as F

from ..operators import pair_blocks as b
from ..operators import similarity as s
from ..operators.contingency import rounded
from ..operators.neighbours import nearest_points
from . import query

PC = ["p_size", "p_retailprice"]
PS = "r AS (SELECT min(p_size) ls, max(p_size) hs, min(p_retailprice) lp, max(p_retailprice) hp FROM part), p AS (SELECT p_partkey k, p_type g, p_brand b, (p_size-ls)*1.0/(hs-ls) x, (p_retailprice-lp)/(hp-lp) y FROM part, r)"
D = "sqrt(((a.x-b.x)^2+(a.y-b.y)^2)/2)"
Q = f"pr AS (SELECT a.k src, b.k dst, {D} d, a.g ga, b.g gb, b.b bb FROM p a JOIN p b ON a.k<>b.k WHERE a.k%20=0), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) rn FROM pr)"


def _parts(read):
    return s.scaled(read("part"), "p_partkey", PC).join(read("part").select("p_partkey", "p_type", "p_brand"), "p_partkey")


def _places(read, group=None):
    return b.of_columns(_parts(read), "p_partkey", PC, group)


def _near(read, k, group=None, every=False):
    """The k nearest parts of those whose key is divisible by 20, or of every part."""
    p = _parts(read).select(F.col("p_partkey").alias("key"), F.array(*PC).alias("v"), (F.col(group) if group else F.lit(None)).cast("string").alias("group"))
    return nearest_points(p if every else p.where("key % 20 = 0"), p, k)


@query(f"WITH {PS}, {Q} SELECT src, dst, round(d,8) AS dist FROM pr")
def pair_distance(read):
    p = _places(read)
    return b.distances(p.where("key % 20 = 0"), p, 8)


@query(f"WITH {PS} SELECT a.k AS k1, b.k AS k2, round({D},8) AS dist FROM p a JOIN p b ON a.b=b.b AND a.k<b.k")
def grouped_pair_distance(read):
    p = _places(read, F.col("p_brand"))
    return b.distances(p, p, 8, ("k1", "k2"), once=True, a_rows=1 << 14, b_rows=1 << 14)


@query(f"WITH {PS}, {Q} SELECT src, dst, round(d,8) AS dist, rn::INT AS rank FROM nn WHERE rn<=5")
def nearest_by_count(read):
    return rounded(_near(read, 5), 8)


@query(f"WITH {PS}, {Q} SELECT src, dst, round(d,8) AS dist FROM pr WHERE d < 0.05")
def nearest_by_dist(read):
    p = _places(read)
    return b.near(p.where("key % 20 = 0"), p, 0.05, len(PC), 8)


@query(f"WITH {PS}, {Q}, m AS (SELECT src, dst, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) rn FROM pr WHERE ga=gb) SELECT src, dst, round(d,8) AS dist, rn::INT AS rank FROM m WHERE rn<=3")
def top_matches_class(read):
    return rounded(_near(read, 3, "p_type"), 8)


EM = "v AS (SELECT vec_id k, label l, embedding::DOUBLE[] e FROM embeddings), pr AS (SELECT a.k src, b.k dst, b.l cls, sqrt(list_sum(list_transform(range(1,len(a.e)+1), lambda i: (a.e[i]-b.e[i])*(a.e[i]-b.e[i])))) d FROM v a JOIN v b ON a.k<>b.k WHERE a.k%20=0), nn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) rn FROM pr)"


def _vec(read, k=7):
    """The k nearest vectors of each whose id is divisible by 20, with their labels."""
    e = read("embeddings")
    v = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"), F.lit(None).cast("string").alias("group"))
    return s.nearest_rows(v.where("key % 20 = 0"), v, k, mean=False).join(e.select(F.col("vec_id").alias("dst"), F.col("label").alias("cls")), "dst")


@query(f"WITH {EM}, c AS (SELECT src, cls, count(*) c FROM nn WHERE rn<=7 GROUP BY 1,2) SELECT src, arg_max(cls, c*1000-cls) AS cls FROM c GROUP BY 1")
def knn_vote(read):
    return s.vote(_vec(read))


@query(f"WITH {EM}, c AS (SELECT src, cls, round(sum(exp(-d*d/2)),9) c FROM nn WHERE rn<=7 GROUP BY 1,2), m AS (SELECT src, max(c) m FROM c GROUP BY 1) SELECT c.src, min(cls) AS cls FROM c JOIN m ON c.src=m.src AND c.c=m.m GROUP BY 1")
def knn_gaussian(read):
    return s.vote(_vec(read), F.exp(-F.col("dist") * F.col("dist") / 2))


@query(f"WITH {EM} SELECT src, round(avg(cls),6) AS prediction FROM nn WHERE rn<=7 GROUP BY 1")
def knn_regress(read):
    return _vec(read).groupBy("src").agg(F.round(F.avg("cls"), 6).alias("prediction"))


@query(f"WITH {PS}, {Q}, z AS (SELECT CASE WHEN ga=gb THEN -1 ELSE 1 END s, abs(a.x-b.x) dx, abs(a.y-b.y) dy FROM nn JOIN p a ON a.k=src JOIN p b ON b.k=dst WHERE rn<=5) SELECT 'p_size' AS feature, round(sum(s*dx)/count(*),8) AS relevance FROM z UNION ALL SELECT 'p_retailprice', round(sum(s*dy)/count(*),8) FROM z")
def relief(read):
    return rounded(s.relief(_near(read, 5), _parts(read), "p_partkey", "p_type", PC), 8)


@query("""WITH b AS (SELECT item_id k, list_distinct(list_filter(regexp_split_to_array(lower(text),'[^a-z]+'), lambda x: x<>'')) w FROM benchmark WHERE item_id%20=0), c AS (SELECT item_id k, list_distinct(list_filter(regexp_split_to_array(lower(text),'[^a-z]+'), lambda x: x<>'')) w FROM benchmark),
p AS (SELECT b.k k1, c.k k2, len(list_intersect(b.w,c.w)) i, len(b.w) n, len(c.w) m FROM b, c) SELECT k1, k2, round(i*1.0/(n+m-i),8) AS jaccard FROM p WHERE i>0""")
def jaccard_texts(read):
    w = s.token_sets(read("benchmark"), "item_id", "text")
    return rounded(s.jaccard(w.where("k % 20 = 0"), w), 8)


@query("WITH v AS (SELECT vec_id k, embedding::DOUBLE[] e FROM embeddings) SELECT a.k AS src, b.k AS dst, round(list_dot_product(a.e,b.e)/sqrt(list_dot_product(a.e,a.e)*list_dot_product(b.e,b.e)),7) AS cosine FROM v a JOIN v b ON a.k<>b.k WHERE a.k%20=0")
def cosine_vectors(read):
    e = read("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"), F.lit(0).alias("group"))
    return b.cosines(e.where("key % 20 = 0"), e, 7)


@query("SELECT a.n_name AS a, b.n_name AS b, round(1-levenshtein(a.n_name,b.n_name)*1.0/greatest(length(a.n_name),length(b.n_name)),6) AS similarity FROM nation a JOIN nation b ON a.n_nationkey<b.n_nationkey AND a.n_regionkey=b.n_regionkey")
def levenshtein_names(read):
    n = read("nation")
    a, b = n.alias("a"), n.alias("b")
    x, y = F.col("a.n_name"), F.col("b.n_name")
    return a.join(b, (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & (F.col("a.n_regionkey") == F.col("b.n_regionkey"))).select(x.alias("a"), y.alias("b"), F.round(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)), 6).alias("similarity"))


@query("""WITH a AS (SELECT c_custkey k, max(o_orderdate) d FROM customer JOIN orders ON o_custkey=c_custkey GROUP BY 1) SELECT count(*) AS customers, count(DISTINCT c_nationkey) AS nations FROM customer WHERE c_custkey IN (SELECT k FROM a)""")
def semi_join(read):
    c = read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    return c.agg(F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(read):
    return read("customer").join(read("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate d, o_totalprice p FROM orders) SELECT o_custkey, o_orderkey, lag(p) OVER (PARTITION BY o_custkey ORDER BY d, o_orderkey) AS earlier FROM o""")
def as_of_previous(read):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read("orders").select("o_custkey", "o_orderkey", F.lag("o_totalprice").over(w).alias("earlier"))


@query("""SELECT a.o_orderkey AS k1, b.o_orderkey AS k2 FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey AND a.o_orderkey<b.o_orderkey AND a.o_orderdate <= b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY""")
def interval_join(read):
    o = read("orders")
    a, b = o.alias("a"), o.alias("b")
    thirty = F.expr("interval 30 days")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.col("a.o_orderdate") <= F.col("b.o_orderdate") + thirty) & (F.col("b.o_orderdate") <= F.col("a.o_orderdate") + thirty)).select(F.col("a.o_orderkey").alias("k1"), F.col("b.o_orderkey").alias("k2"))
