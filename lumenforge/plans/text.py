from pyspark.sql import functions as F

from ..operators import text as t
from ..operators.contingency import rounded
from . import query

TOK = "list_filter(regexp_split_to_array(lower(coalesce(text,'')),'[^a-z]+'), lambda x: x<>'')"
C = f"c AS (SELECT conv_id, turn, {TOK} w FROM conversations)"


def _conv(read):
    return read("conversations")


@query(f"WITH {C} SELECT u AS term, count(*) AS n FROM (SELECT unnest(w) u FROM c) GROUP BY 1")
def word_count(read):
    return t.counts(_conv(read), t.tokens(F.col("text")))


@query("SELECT w AS term, count(*) AS n FROM (SELECT unnest(string_split(text,' ')) w FROM conversations) GROUP BY 1")
def whitespace_word_count(read):
    return t.counts(_conv(read), F.split("text", " "))


def _ng(n):
    return f"WITH {C}, g AS (SELECT array_to_string(w[i:i+{n - 1}],' ') term FROM (SELECT w, unnest(range(1,len(w)-{n}+2)) i FROM c WHERE len(w)>={n})) SELECT term, count(*) AS n FROM g GROUP BY 1"


@query(_ng(2))
def bigrams(read):
    return t.counts(_conv(read), t.ngrams(t.tokens(F.col("text")), 2))


@query(_ng(3))
def trigrams(read):
    return t.counts(_conv(read), t.ngrams(t.tokens(F.col("text")), 3))


@query("SELECT g AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text,'.{3}',0,'s')) g FROM benchmark) GROUP BY 1")
def char_ngrams(read):
    return t.counts(read("benchmark"), t.char_ngrams(F.col("text"), 3))


B = f"b AS (SELECT item_id, unnest({TOK}) term FROM benchmark), tf AS (SELECT item_id, term, count(*) n FROM b GROUP BY 1,2), d AS (SELECT term, count(*) df FROM tf GROUP BY 1)"


@query(f"WITH {B} SELECT item_id, term, n FROM tf")
def term_frequency(read):
    return t.counts(read("benchmark"), t.tokens(F.col("text")), "item_id")


@query(f"WITH {B} SELECT item_id, tf.term, n, round(n*ln((SELECT count(*) FROM benchmark)*1.0/df),8) AS tf_idf FROM tf JOIN d ON tf.term=d.term")
def tf_idf(read):
    return rounded(t.tf_idf(read("benchmark"), "item_id", t.tokens(F.col("text"))), 8)


@query(f"WITH c AS (SELECT item_id, list_filter({TOK}, lambda x: len(x)>=3 AND x NOT IN ('the','and','that')) w FROM benchmark) SELECT item_id, array_to_string(w,' ') AS clean FROM c")
def token_clean(read):
    return read("benchmark").select("item_id", F.array_join(t.tokens(F.col("text"), stop=["the", "and", "that"], least=3), " ").alias("clean"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(html,'<(script|style)\b[^>]*>.*?</(script|style)>',' ','gis') t FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(t,'<!--.*?-->',' ','gs'),'<[^>]*>',' ','gs') t FROM a)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t,'&lt;','<'),'&gt;','>'),'&quot;','"'),'&nbsp;',' '),'&amp;','&'),'\s+',' ','g')) AS text FROM b""")
def html_strip(read):
    return read("pages").select("page_id", t.strip_html(F.col("html")).alias("text"))


@query(r"SELECT item_id, (pos-1)::INT AS pos, paragraph FROM (SELECT item_id, unnest(p) paragraph, unnest(range(1,len(p)+1)) pos FROM (SELECT item_id, regexp_split_to_array(text,'\n+') p FROM benchmark)) WHERE trim(paragraph)<>''")
def paragraphs(read):
    return t.paragraphs(read("benchmark"), "item_id", "text")


@query(r"SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text,'\S+')) AS words, len(regexp_extract_all(text,'[.!?]')) AS stops, len(regexp_extract_all(text,'[A-Z]')) AS upper, len(regexp_extract_all(text,'[0-9]')) AS digits FROM documents")
def doc_features(read):
    f = t.features(read("documents"), "doc_id", "text")
    return f.select("doc_id", *(F.col(c).cast("long").alias(c) for c in f.columns[1:]))


@query()
def sentence_scores(read):
    return rounded(t.sentence_scores(read("benchmark"), "item_id", "text"), 8)


@query()
def sumbasic(read):
    return t.summarise(read("benchmark"), "item_id", "text", "sumbasic", 2)


@query()
def textrank(read):
    return t.summarise(read("benchmark"), "item_id", "text", "textrank", 2)


@query(f"WITH {B}, s AS (SELECT item_id, tf.term, n*ln((SELECT count(*) FROM benchmark)*1.0/df) s FROM tf JOIN d ON tf.term=d.term), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s,9) DESC, term) rn FROM s) SELECT item_id, term, rn::INT AS rank FROM r WHERE rn<=3")
def top_terms(read):
    return t.top_terms(t.tf_idf(read("benchmark"), "item_id", t.tokens(F.col("text"))), "item_id", 3).select("item_id", "term", "rank")
