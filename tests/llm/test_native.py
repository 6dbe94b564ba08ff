import hashlib
import random
import re

from lumenforge.llm import licenses, pii

DDL = "doc_id long, text string, n_words string, row long, found string"
rows = lambda texts: [(i, t, "x", 1, None) for i, t in enumerate(texts)]


def test_license_base_matches_brute_force(spark):
    r = random.Random(3)
    bits = ["CC", "by", "BY-NC", "general", "Public", "License", "all", "rights", "reserved.", "é", "x", "4.0", "under", "licensed", "mit", "K", "CCé", "_"]
    texts = [" ".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(200)] + [None, "", "CC BY " * 3, "all rights reserved all rights reserved", "w " * 3000 + "cc-by"]
    got = {x.doc_id: x for x in licenses.license_scan(spark.createDataFrame(rows(texts), DDL)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == licenses.brute_scan(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_license_templates(spark):
    texts = ["x\nReleased under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "ich gehe mit", "the license is by apache"]
    got = {x.doc_id: x.labels for x in licenses.license_scan(spark.createDataFrame(rows(texts), DDL)).collect()}
    assert got == {0: "mit", 1: "gpl,gpl-3.0", 2: "cc-by,cc-by-nc-4.0", 3: "apache-2.0", 4: "", 5: ""}
    assert licenses.license_scan(spark.createDataFrame([], DDL)).count() == 0


def test_license_labels_match_brute_force(spark):
    """Every template at every place, cut off at the text's ends, with words replaced, near one another, in texts of any licence words."""
    r = random.Random(12)
    known = licenses.read_templates()
    vocabulary = sorted({w for t in known for w in t.words})
    texts = [None, "", "K " * 30]
    for t in known:
        for _ in range(3):
            w = list(t.words)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = r.choice([*vocabulary, "other"])
            cut = w[r.randrange(3) if r.random() < 0.5 else 0 :]
            texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(5))] + cut + [r.choice(vocabulary) for _ in range(r.randrange(9))]).upper())
    texts += [" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(20)]
    got = sorted((x.doc_id, x.labels, round(x.score, 9)) for x in licenses.license_scan(spark.createDataFrame(rows(texts), DDL)).collect())
    want = [(i, a, round(b, 9)) for i, (a, b) in enumerate(licenses.brute_labels(texts))]
    assert got == want and len({a for _, a, _ in want}) > 15


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    """Of both native operators: each row has its own result."""
    d = spark.createDataFrame([(1, "all rights reserved a@b.c"), (1, "cc by 1.2.3.4"), (1, "cc by 1.2.3.4"), (None, "x y"), (None, "general public license +1 609 555 7932")], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_words, x.base_labels) for x in licenses.license_scan(d).collect())
    assert got == [("1", 6, "cc-by"), ("1", 6, "cc-by"), ("1", 6, "reserved"), ("None", 2, ""), ("None", 7, "gpl")]
    got = sorted((str(x.doc_id), x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.pii_digest(d).collect())
    assert got == [("1", 0, 1, 0, 0), ("1", 0, 1, 0, 0), ("1", 1, 0, 0, 0), ("None", 0, 0, 0, 0), ("None", 0, 0, 0, 1)]


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def texts():
    r = random.Random(4)
    bits = ["a@b.c", "x.y", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "0" * 16, "1", "22", " ", " ", "-", "+1 (609) 555-7932", "+49", "(", ")", "é", "日", "😀", "_", "..", "5", "token = \"5d190bd7c06284de91015a36974748794293dd8a\"", "\n", "@m.org", "%"]
    out = ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(400)]
    return out + [None, "", "0" * 3000 + " " + "4" * 16, "0" * 80, "0" * 63 + "1" * 20, "1 " * 5000, "1." * 3000, "a" * 20000, "a@b" + ".c" * 20000, "1-" * 200 + "x 4111111111111111", "a@b.c_d@e.f", "a@b.c@d.e.f", "0" * 64 + " " + "0" * 16, "0" * 64 + "- " + "0" * 16]


def test_pii_base_matches_brute_force(spark):
    t = texts()
    got = {x.doc_id: x for x in pii.pii_digest(spark.createDataFrame(rows(t), DDL)).collect()}
    assert len(got) == len(t)
    order = ("email", "ip", "card", "phone")
    for i, x in enumerate(t):
        b = sorted(brute(x), key=lambda s: (order.index(s[0]), s[1]))
        want = ",".join(f"{k}:{a}:{e}" for k, a, e in b)
        g = got[i]
        assert g.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (x, want, g.spans)
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(s[0] == k for s in b) for k in order]
        spans = set(filter(None, g.spans.split(",")))
        assert set(filter(None, want.split(","))) <= spans
    assert sum(g.n_card for g in got.values()) > 10


def test_pii_adds_loose_spans_and_leaves_prose(spark):
    key = "5d190bd7c06284de91015a36974748794293dd8a"
    t = [f'the token = "{key}" here', "call (609) 555-7932 now", "plain words of averylongwordwithoutanydigitsatall here"] * 20
    got = [x.spans for x in pii.pii_digest(spark.createDataFrame(rows(t), DDL)).collect()]
    assert sorted(set(got)) == ["", "local_phone:5:19", f"secret:{(at := t[0].index(key))}:{at + len(key)}"]
    assert pii.pii_digest(spark.createDataFrame([], DDL)).count() == 0


def test_pii_finds_long_secrets_and_account_numbers(spark):
    """Keys of any length; account numbers of all countries in the list, spaced or not, and none that fails its check digits."""
    r = random.Random(6)
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "IT60X0542811101000000123456", "NL91ABNA0417164300", "CH9300762011623852957", "ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "PL61109010140000071219812874"]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in ibans]
    wrong = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in ibans]
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (32, 40, 180, 202, 1000, 30_000)]
    t = [f"my iban is {x}, thanks" for x in ibans + spaced] + [f"my iban is {x}, thanks" for x in wrong] + [f"token = {k} end" for k in keys]
    got = {x.doc_id: x.spans for x in pii.pii_digest(spark.createDataFrame(rows(t * 3), DDL)).collect()}
    for i, x in enumerate(ibans + spaced):
        assert f"iban:11:{11 + len(x)}" in got[i].split(","), (x, got[i])
    n = len(ibans + spaced)
    assert not any("iban" in got[n + i] for i in range(len(wrong)))
    for i, k in enumerate(keys):
        assert f"secret:8:{8 + len(k)}" in got[n + len(wrong) + i].split(",")


def test_recall_of_planted_spans(spark):
    """Nine of ten spans at least, of each kind that the method adds, planted in prose; prose alone has none."""
    r = random.Random(9)
    words = "the report was sent to our office on monday and they will answer soon about this".split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    make = {
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
        "local_phone": lambda: f"({r.randrange(200, 999)}) {r.randrange(200, 999)}-{r.randrange(1000, 9999)}",
        "ssn": lambda: f"{r.randrange(100, 600)}-{r.randrange(10, 99)}-{r.randrange(1000, 9999)}",
    }
    lead = {"secret": "api key: ", "local_phone": "call ", "ssn": "ssn "}
    t, want = [], {}
    for i in range(300):
        kind = list(make)[i % 4] if i % 4 < 3 else None
        a = say(20) + " "
        if kind:
            a += lead[kind]
            x = make[kind]()
            want[i] = f"{kind}:{len(a)}:{len(a) + len(x)}"
            a += x
        t.append(a + " " + say(10))
    got = {x.doc_id: x.spans.split(",") for x in pii.pii_digest(spark.createDataFrame(rows(t), DDL)).collect()}
    for kind in make:
        mine = [i for i, s in want.items() if s.startswith(kind)]
        assert sum(want[i] in got[i] for i in mine) >= 0.9 * len(mine), kind
    assert all(got[i] == [""] for i in range(300) if i not in want)
