from pyspark.sql import functions as F

from ..operators import text as t
from ..operators import text_clean as c
from ..operators import text_models as m
from ..operators.contingency import rounded
from . import query
from .text import TOK

SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x<>'')"


@query(r"SELECT item_id, regexp_replace(text, '[^\x00-\x7F]+', '', 'g') AS plain, regexp_replace(text, '\[[^\]]*\]', '', 'g') AS flat FROM benchmark")
def ascii_and_brackets(read):
    return read("benchmark").select("item_id", c.ascii_only(F.col("text")).alias("plain"), c.without_brackets(F.col("text")).alias("flat"))


@query("SELECT doc_id, " + "replace(" * len(c.CONTRACTIONS) + "lower(text)" + "".join(f", '{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in c.CONTRACTIONS.items()) + " AS text FROM documents")
def expand_contractions(read):
    return read("documents").select("doc_id", c.expanded(F.col("text")).alias("text"))


@query(r"SELECT c_custkey, trim(regexp_replace(" + "replace(" * 10 + "c_name" + "".join(f", '{i}', ' {w} ')" for i, w in enumerate(c.DIGITS)) + r", '\s+', ' ', 'g')) AS name FROM customer")
def number_words(read):
    return read("customer").select("c_custkey", c.digits_as_words(F.col("c_name")).alias("name"))


@query(f"WITH w AS (SELECT conv_id, turn, {TOK} w FROM conversations) SELECT conv_id, turn, array_to_string(list_filter(w, lambda x: length(x)>=3 AND x NOT IN ({','.join(repr(x) for x in c.STOP)})), ' ') AS tokens FROM w")
def token_filters(read):
    return read("conversations").select("conv_id", "turn", F.array_join(c.kept(t.tokens(F.col("text")), c.STOP, 3), " ").alias("tokens"))


@query(f"WITH w AS (SELECT item_id, unnest({TOK}) term, generate_subscripts({TOK}, 1) pos FROM benchmark), k AS (SELECT term FROM w GROUP BY 1 HAVING count(*) > 3) SELECT item_id, string_agg(term, ' ' ORDER BY pos) AS tokens FROM w WHERE term IN (SELECT term FROM k) GROUP BY 1")
def frequent_tokens(read):
    return c.frequent_tokens(read("benchmark"), "item_id", t.tokens(F.col("text")), 3).select("item_id", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH s AS (SELECT item_id, {SENT} s FROM benchmark) SELECT item_id, (i-1)::INT AS pos, array_to_string(s[i:i+1], ' ') AS passage FROM (SELECT item_id, s, unnest(range(1, greatest(1, len(s)-1)+1)) i FROM s WHERE len(s) > 0)")
def passages(read):
    return read("benchmark").select("item_id", F.posexplode(c.passages(t.sentences(F.col("text")), 2)).alias("pos", "passage"))


@query(f"SELECT item_id, list_contains({TOK}, 'the') AS has_the, list_contains({TOK}, 'that') AS has_that FROM benchmark")
def word_flags(read):
    return read("benchmark").select("item_id", *c.has_words(t.tokens(F.col("text")), ["the", "that"]))


@query(f"WITH w AS (SELECT item_id, {TOK} w FROM benchmark), g AS (SELECT item_id, w[i]||' '||w[i+1] gram FROM (SELECT item_id, w, unnest(range(1,len(w))) i FROM w WHERE len(w)>=2)), v AS (SELECT gram, row_number() OVER (ORDER BY gram)-1 idx FROM g GROUP BY 1 HAVING count(*)>=3) SELECT item_id, idx::INT AS idx, count(*) AS count FROM g JOIN v ON g.gram=v.gram GROUP BY 1,2")
def bigram_vectors(read):
    return c.ngram_vector(read("benchmark"), "item_id", t.ngrams(t.tokens(F.col("text")), 2), 3)


@query()
def stems(read):
    return c.stemmed(read("benchmark"), "item_id", c.clean(F.col("text"))).select("item_id", F.array_join("stems", " ").alias("stems"))


@query(f"WITH s AS (SELECT item_id, unnest({SENT}) s, generate_subscripts({SENT}, 1)-1 pos FROM benchmark), w AS (SELECT item_id, pos, unnest({TOK.replace('text', 's')}) term FROM s), n AS (SELECT term, count(*) n FROM w GROUP BY 1) SELECT item_id, pos::INT AS pos, round(sum(n)/count(*),7) AS score FROM w JOIN n ON w.term=n.term GROUP BY 1,2")
def term_frequency_summary(read):
    return rounded(m.term_frequency_scores(read("benchmark"), "item_id", "text"), 7)


@query(f"WITH s AS (SELECT item_id, unnest({SENT}) s, generate_subscripts({SENT}, 1)-1 pos FROM benchmark), w AS (SELECT item_id, pos, unnest({TOK.replace('text', 's')}) term FROM s), n AS (SELECT term, count(*) n FROM w GROUP BY 1), x AS (SELECT item_id, pos, round(sum(n)/count(*),9) score FROM w JOIN n ON w.term=n.term GROUP BY 1,2), r AS (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) rank FROM x) SELECT item_id, pos::INT AS pos, rank::INT AS rank FROM r WHERE rank <= 2")
def summary_sentences(read):
    return m.top_sentences(m.term_frequency_scores(read("benchmark"), "item_id", "text"), "item_id", 2).select("item_id", "pos", "rank")


def _summary(kind):
    return lambda read: m.summarise(read("benchmark"), "item_id", "text", kind, 2)


for _k in ("lsa", "nmf", "mmr"):
    query(name=f"{_k}_summary")(_summary(_k))


@query()
def lda_topics(read):
    from pyspark.ml.functions import vector_to_array

    model, d = m.topic_model(read("conversations"), c.clean(F.col("text")))
    x = model.transform(d).select("conv_id", "turn", vector_to_array("topicDistribution").alias("p"))
    return x.select("conv_id", "turn", F.array_position("p", F.array_max("p")).alias("topic"), F.round(F.array_max("p"), 4).alias("share"))


@query()
def lda_terms(read):
    model, _ = m.topic_model(read("conversations"), c.clean(F.col("text")))
    words = model.stages[0].vocabulary
    top = model.stages[1].describeTopics(5)
    return top.select("topic", F.posexplode("termIndices").alias("rank", "i"), "termWeights").select("topic", "rank", F.element_at(F.lit(words) if words else F.array(F.lit("")), F.col("i") + 1).alias("term"), F.round(F.element_at("termWeights", F.col("rank") + 1), 6).alias("weight"))


@query()
def word2vec(read):
    from pyspark.ml.functions import vector_to_array

    model, _ = m.word_vectors(read("conversations"), c.clean(F.col("text")))
    return model.getVectors().select("word", F.transform(vector_to_array("vector"), lambda x: F.round(x, 4)).alias("vector"))


@query()
def document_vectors(read):
    from pyspark.ml.functions import vector_to_array

    model, d = m.word_vectors(read("conversations"), c.clean(F.col("text")))
    return model.transform(d).select("conv_id", "turn", F.transform(vector_to_array("vector"), lambda x: F.round(x, 4)).alias("vector"))


TS = "t AS (SELECT conv_id, turn, unnest(list_distinct(" + TOK + ")) w FROM conversations), p AS (SELECT a.conv_id d1, b.conv_id d2, a.turn t1, b.turn t2, count(*) s FROM t a JOIN t b ON a.w=b.w AND b.conv_id=a.conv_id+1 GROUP BY 1,2,3,4)"


@query(f"WITH {TS}, r AS (SELECT d1, d2, t1, max(s) m, avg(s) a FROM p GROUP BY 1,2,3), x AS (SELECT d1, d2, avg(m) am, max(a) ma FROM r GROUP BY 1,2), y AS (SELECT d1, d2, avg(s) a, median(s) m, max(s) g FROM p GROUP BY 1,2) SELECT y.d1, y.d2, round(a,6) AS average, round(m,6) AS median, g AS greatest, round(am,6) AS avg_of_max, round(ma,6) AS max_of_avg FROM x JOIN y ON x.d1=y.d1 AND x.d2=y.d2")
def similarity_aggregates(read):
    """Of the words that turns of one conversation share with turns of the next."""
    w = read("conversations").select("conv_id", "turn", F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("w"))
    a = w.select(F.col("conv_id").alias("d1"), F.col("turn").alias("t1"), "w", (F.col("conv_id") + 1).alias("d2"))
    b = w.select(F.col("conv_id").alias("d2"), F.col("turn").alias("t2"), "w")
    p = a.join(b, ["d2", "w"]).groupBy("d1", "d2", "t1", "t2").agg(F.count("*").alias("s"))
    return rounded(m.aggregate_pairs(p, "t1", "t2", "s"))


@query(f"WITH {TS} SELECT d1, round(median(s),6) AS score FROM p GROUP BY 1")
def score_aggregates(read):
    w = read("conversations").select("conv_id", "turn", F.explode(F.array_distinct(t.tokens(F.col("text")))).alias("w"))
    a = w.select(F.col("conv_id").alias("d1"), F.col("turn").alias("t1"), "w", (F.col("conv_id") + 1).alias("d2"))
    b = w.select(F.col("conv_id").alias("d2"), F.col("turn").alias("t2"), "w")
    p = a.join(b, ["d2", "w"]).groupBy("d1", "d2", "t1", "t2").agg(F.count("*").alias("s"))
    return rounded(m.aggregate_scores(p, "d1", "s", "median"))


@query(f"WITH n AS (SELECT o_orderstatus cls, unnest(string_split(lower(o_orderpriority),'-')) term FROM orders) SELECT cls, term, count(*) AS n FROM n GROUP BY 1,2")
def nb_text_distribution(read):
    o = read("orders").select(F.col("o_orderstatus").alias("cls"), F.explode(F.split(F.lower("o_orderpriority"), "-")).alias("term"))
    return o.groupBy("cls", "term").agg(F.count("*").alias("n"))
