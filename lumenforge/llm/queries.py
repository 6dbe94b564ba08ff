"""Queries of the training-data operators, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, licenses, mixing, pii, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from ._common import UPPER


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark, sf_dir):
    return licenses.license_scan(_read(spark, sf_dir, "documents")).withColumn("score", F.round("score", 9))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    return mixing.mixed(_read(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_simhash(spark, sf_dir):
    got = simhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, words=1, limit=3)
    digits = F.lower(F.concat(*[F.substring(F.hex("print"), 15 - 2 * i, 2) for i in range(8)]))  # bytes from the last
    return got.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_exact(spark, sf_dir):
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.pii_digest(_read(spark, sf_dir, "documents"))


def op8_substring(spark, sf_dir):
    return substring_dedup.drop_repeated_words(_read(spark, sf_dir, "documents"))


def op9_suffix(spark, sf_dir):
    return suffix_dedup.drop_repeated_bytes(_read(spark, sf_dir, "documents"))


def op10_langid(spark, sf_dir):
    return langid.identify(_read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_licenses, op2_toxicity, op3_mixing, op4_decontamination, op5_simhash, op6_exact, op7_pii, op8_substring, op9_suffix, op10_langid, pipeline)}

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
TEMPLATES = ",".join(f"({i},'{t.label}',{t.base},'{w}',{j},{int(t.lo <= j < t.hi)})" for i, t in enumerate(licenses.read_templates()) for j, w in enumerate(t.words))
ORACLE = {
    "op1_licenses": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW}, '{licenses.WORD}') AS w FROM documents),
        t AS (SELECT * FROM (VALUES {TEMPLATES}) t(template, label, base, word, pos, own)),
        v AS (SELECT DISTINCT word FROM t),
        o AS MATERIALIZED (SELECT * FROM (SELECT r, unnest(w) AS x, unnest(range(0, len(w))) AS i FROM d) WHERE x IN (FROM v)),
        f AS (SELECT word, ln(((SELECT count(*) FROM d) + 1.0::DOUBLE) / (coalesce(n, 0) + 1.0::DOUBLE)) + 0.01 AS idf FROM v LEFT JOIN (SELECT x, count(DISTINCT r) AS n FROM o GROUP BY 1) ON x = word),
        k AS (SELECT template, sum(own) AS keys, sum(idf) AS total FROM t JOIN f USING (word) GROUP BY 1),
        m AS (SELECT r, template, any_value(label) AS label, any_value(base) AS base, i - pos AS start, sum(own) AS keys, sum(idf) AS s FROM o JOIN t ON x = t.word JOIN f ON f.word = x GROUP BY r, template, i - pos),
        h AS (SELECT r, label, base, start, s / total AS share FROM m JOIN k ON k.template = m.template AND k.keys = m.keys WHERE base OR s / total >= 0.5),
        g AS (SELECT r, count_if(base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, list_sort(list_distinct(list(label) FILTER (base))) AS b, list_sort(list_distinct(list(label))) AS l, least(max(share), 1.0) AS score FROM h GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, round(coalesce(score, 0), 9) AS score FROM d LEFT JOIN g ON g.r = d.r""",
    "op9_suffix": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2)) AS i FROM d),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN i <= n - 50 THEN substr(h, 2 * i + 1, 100) END AS s FROM p),
        f AS (SELECT doc_id, i, b, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN i END AS hit FROM w),
        c AS (SELECT doc_id, i, b, coalesce(max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) > i - 50, false) AS gone FROM f),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM c),
        a AS (SELECT doc_id, count_if(gone) AS n_removed, count_if(head) AS n_spans, string_agg(CASE WHEN NOT gone THEN b END, '' ORDER BY i) AS kept FROM e GROUP BY 1)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id""",
    "op6_exact": f"""
        WITH d AS (SELECT doc_id, sha256({LOW}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_substring": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
        h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
        f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM h),
        g AS (SELECT DISTINCT doc_id, i + j AS i FROM f, range(0, 13) t(j) WHERE least < doc_id),
        l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
        u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS s FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(l.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
        FROM d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN k ON d.doc_id = k.doc_id""",
}
