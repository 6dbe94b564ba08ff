"""The eleven queries on the driver's smallest tables: contract columns, SQL where there is some, else brute force."""

import hashlib
import os
import zlib

import pytest

from lumenforge.llm.licenses import brute_scan
from lumenforge.llm.queries import ORACLE, QUERIES
from tests import oracle

from .test_dedup import brute_print, classes
from .test_native import brute as brute_pii
from .test_repeats import brute

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
COLUMNS = {
    "op1_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op2_toxicity": "doc_id held_out score predicted",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_exact": "doc_id keep_id group_size kept text_sha256",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_substring": "doc_id n_words n_removed kept_sha256",
    "op9_suffix": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_langid": "doc_id held_out lang_pred score",
}


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", list(COLUMNS))
def test_contract_columns_and_rows(spark, docs, name):
    got = QUERIES[name](spark, DIR)
    assert set(COLUMNS[name].split()) <= set(got.columns)
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    for r in rows:
        if "held_out" in got.columns:
            n, k = (3, 1) if name == "op2_toxicity" else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k)
        if "score" in got.columns:
            assert 0 <= r.score <= 1
        if name == "op2_toxicity":
            assert r.predicted == int(r.score >= 0.7)


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    assert oracle.difference(spark, oracle.connect(DIR), DIR, QUERIES[name], ORACLE[name]) == ""


def test_licenses(spark, docs):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in QUERIES["op1_licenses"](spark, DIR).collect()}
    assert got == {i: brute_scan(t) for i, t in docs}


def test_pii(spark, docs):
    order = ("email", "ip", "card", "phone")
    got = {r.doc_id: r for r in QUERIES["op7_pii"](spark, DIR).collect()}
    for i, t in docs:
        b = sorted(brute_pii(t), key=lambda s: (order.index(s[0]), s[1]))
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{e}" for k, a, e in b).encode()).hexdigest()


def test_simhash(spark, docs):
    fp = {i: brute_print(t) for i, t in docs}
    want = classes(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, DIR).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_suffix(spark, docs):
    want = {}
    for i, u, g in brute(docs, lambda t: (t or "").encode(), 50):
        runs = sum(1 for a, b in zip([False, *g], g) if b and not a)
        want[i] = (len(u), sum(g), runs, hashlib.sha256(bytes(x for x, k in zip(u, g) if not k)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix"](spark, DIR).collect()}
    assert got == want


def test_substring(spark, docs):
    want = {i: (len(u), sum(g), hashlib.sha256(b" ".join(x for x, k in zip(u, g) if not k)).hexdigest()) for i, u, g in brute(docs, lambda t: (t or "").encode().split(), 13)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring"](spark, DIR).collect()}
    assert got == want


def test_models_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op10_langid"](spark, sf).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, toxic[r.doc_id]) for r in QUERIES["op2_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    yes, no = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no) > 0.75


def test_benchmark_passages_are_found(spark, docs):
    """Recall of whole items, found here by search, of 0.9 at least."""
    import re

    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = {(i, k) for i, t in docs for k, x in items if x.strip() and x in plain(t)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, DIR).collect()}
    assert want and len(want & got) >= 0.9 * len(want)
