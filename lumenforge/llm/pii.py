"""PII by weak supervision.  DataFrame operations only on the main path.

1. *Candidates.*  Patterns of each kind give spans (code points); the four base kinds with
   their checks always stay, loose kinds are decided by the model.
2. *Labelers* vote 1, 0 or -1 on each candidate: strict form, gazetteer (top-level domains,
   issuer prefixes, key names), cue words in the context, and edges (what touches the span).
3. *Reliabilities.*  Votes are counted by (kind, votes) in Spark, at most 81 rows a kind;
   expectation-maximisation over these counts estimates how often each labeler is right.
4. *Span classifier.*  Logistic regression on features of the span (kind, votes, length class),
   trained on the counts by feature with the posteriors of step 3 as soft labels, and applied
   as a column expression.

Defined cases: null and empty texts have no spans; a loose span that touches a base span is
dropped; repeated and null ids are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import parts, stored

BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
LOCAL = "A-Za-z0-9._%+-"
#: kind: pattern, and a text that each match holds or a pattern to look for first
PATTERNS = {
    # the domain one character at a time: a loop over labels would recurse
    "email": (rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15,63}", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "local_phone": (r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])", None),
    "secret": (r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", None),
}
BASE = ("email", "ip", "card", "phone")
CUES = {
    "email": "mail|contact|write|reply|from|to:",
    "ip": r"\bip\b|host|server|address|addr|login|from",
    "card": "card|visa|master|credit|debit|payment|amex",
    "phone": r"tel|phone|call|mobile|fax|cell|contact|whatsapp",
    "local_phone": r"tel|phone|call|mobile|fax|cell|contact|whatsapp",
    "secret": r"token|secret|passw|api|key|auth|bearer|credential",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|bank",
}
#: fixed values: characters of an account number by country
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "NL": 18, "PL": 28}
KEYS = ("strict", "gazetteer", "context", "edges")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + _luhn_digit(F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int"), i))
    return total % 10 == 0


def _luhn_digit(x: Column, i: Column) -> Column:
    twice = x * 2
    return F.when(i % 2 == 1, x).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def mod97(s: Column) -> Column:
    """Remainder of an account number by 97, its first four characters last and letters counting from 10; 1 if valid."""
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def _span(kind: str):
    return lambda z, i: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), z["m"].alias("span"), F.length(z["s"]).alias("skip"), F.right(z["s"], F.lit(40)).alias("before"), F.left(z["n"], F.lit(20)).alias("after"))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and spans (row, kind, start, end, span, before, after)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    each = []
    for kind, (pattern, holds) in PATTERNS.items():
        p = F.lit(pattern)
        m, s = F.regexp_extract_all(t, p, F.lit(0)), F.split(t, pattern, -1)
        found = F.transform(F.arrays_zip(m.alias("m"), F.slice(s, 1, F.size(m)).alias("s"), F.slice(s, 2, F.size(m)).alias("n")), _span(kind))
        has = t.contains(holds) if holds else t.rlike(pattern)
        each.append(F.when(has & (F.length(t) > 0), found).otherwise(F.array().cast("array<struct<kind:string,i:int,span:string,skip:int,before:string,after:string>>")))
    base = parts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat(*each).alias("found"))
    base = stored(base, "spans")
    spans = base.select("row", F.explode("found").alias("f")).select("row", "f.*")
    w = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("skip") + F.length("span")).over(w)
    spans = spans.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("span"))
    same = Window.partitionBy("row", "kind").orderBy("i")
    gap = F.col("start") - F.lag("end").over(same)
    # a chain of over 64 digits comes in pieces, of which none is a card
    joined = (F.col("kind") == "card") & F.coalesce((gap == 0) | ((gap == 1) & F.col("before").rlike("(?:^|[0-9])[ -]$")), F.lit(False))
    spans = spans.withColumn("joined", joined)
    n, bare = F.length(digits(F.col("span"))), F.regexp_replace("span", " ", "")
    ok = (
        F.when(F.col("kind") == "ip", F.col("span").rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"))
        .when(F.col("kind") == "card", ~F.col("joined") & n.between(16, 19) & luhn(digits(F.col("span"))))
        .when(F.col("kind") == "phone", n.between(8, 15))
        .when(F.col("kind") == "iban", F.length(bare).between(15, 34) & (mod97(bare) == 1))
        .otherwise(F.lit(True))
    )
    return base.select("row", "doc_id"), spans.where(ok).drop("i", "skip", "joined")


def votes(spans: DataFrame) -> DataFrame:
    """Adds the labelers' votes and the length class."""
    k, s, before, after = F.col("kind"), F.col("span"), F.lower("before"), F.lower("after")
    one, none, less = F.lit(1), F.lit(0), F.lit(-1)
    n = F.length(digits(s))
    bare = F.regexp_replace(s, " ", "")
    has_digit, has_alpha = s.rlike("[0-9]"), s.rlike("[A-Za-z]")
    strict = (
        F.when(k == "email", F.when(s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,24}$"), one).otherwise(less))
        .when(k == "ip", F.when(s.rlike(r"(?:^|\.)0[0-9]"), less).otherwise(one))
        .when(k == "card", F.when(n == 16, one).otherwise(none))
        .when(k == "phone", F.when(n.between(10, 13), one).otherwise(none))
        .when(k == "local_phone", F.when(digits(s).rlike("^[2-9]"), one).otherwise(less))
        .when(k == "secret", F.when(has_digit & has_alpha & s.rlike("^(?:[0-9a-f]{32,}|(?:sk|pk|ghp|AKIA|xox)[A-Za-z0-9_-]+)$"), one).when(has_digit & has_alpha, none).otherwise(less))
        .when(k == "ssn", F.when(s.rlike("^(?:000|666|9)|-00-|-0000$"), less).otherwise(one))
        .otherwise(one)
    )
    known_length = F.lit(0)
    for country, size in IBAN_LENGTHS.items():
        known_length = F.when(s.startswith(country), F.when(F.length(bare) == size, one).otherwise(less)).otherwise(known_length)
    gazetteer = (
        F.when(k == "email", F.when(s.rlike(r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|biz)$"), one).otherwise(none))
        .when(k == "ip", F.when(s.rlike(r"^(?:10|127|192\.168|172)\."), one).otherwise(none))
        .when(k == "card", F.when(s.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), one).otherwise(none))
        .when(k == "phone", F.when(s.rlike(r"^\+(?:1|3[0-9]|4[0-9])"), one).otherwise(none))
        .when(k == "local_phone", F.when(s.contains("555"), one).otherwise(none))
        .when(k == "secret", F.when(s.rlike("^(?:AKIA|ghp_|sk[-_]|pk[-_]|xox[bp]-|eyJ)"), one).otherwise(none))
        .when(k == "iban", known_length)
        .otherwise(none)
    )
    context = none
    for kind, cue in CUES.items():
        context = F.when(k == kind, F.when(before.rlike(cue) | after.rlike(cue), one).when(before.rlike(r"(?:version|v|\bno|nr|isbn|sku|rev)[ .:#]*$"), less).otherwise(none)).otherwise(context)
    edges = F.when(before.rlike(r"[a-z0-9]$") | after.rlike(r"^[a-z0-9]"), less).when(before.rlike(r"""(?:^|[\s"'(<=:])$""") & after.rlike(r"""^(?:$|[\s"')>,.;])"""), one).otherwise(none)
    return spans.withColumns({"strict": strict, "gazetteer": gazetteer, "context": context, "edges": edges, "size": F.least(F.floor(F.length("span") / 8), F.lit(6)).cast("int")})


def reliabilities(counts: list[tuple], rounds: int = 60) -> dict[tuple, float]:
    """Posterior of (kind, votes), by EM over the counts: a prior for each kind, and for each
    labeler the probabilities of its three votes given the truth, shared by all kinds.
    """
    kinds = {c[0] for c in counts}
    prior = dict.fromkeys(kinds, 0.5)
    table = {(j, y): {1: 0.6 if y else 0.15, 0: 0.3, -1: 0.1 if y else 0.55} for j in range(len(KEYS)) for y in (0, 1)}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, *v, _n in counts:
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, x in enumerate(v):
                a += math.log(table[j, 1][x])
                b += math.log(table[j, 0][x])
            post[kind, *v] = 1 / (1 + math.exp(max(-500, min(500, b - a))))
        for k in kinds:
            n = sum(c[-1] for c in counts if c[0] == k)
            prior[k] = (1 + sum(post[c[:-1]] * c[-1] for c in counts if c[0] == k)) / (n + 2)
        for j, y in table:
            mass = {x: 5 * (0.6 if (x == 1) == bool(y) and x else 0.3 if x == 0 else 0.15) for x in (1, 0, -1)}  # keeps a labeler better than chance
            for c in counts:
                mass[c[1 + j]] += c[-1] * (post[c[:-1]] if y else 1 - post[c[:-1]])
            total = sum(mass.values())
            table[j, y] = {x: m / total for x, m in mass.items()}
    return post


def classifier(counts: list[tuple], post: dict[tuple, float], rounds: int = 200) -> dict[tuple, float]:
    """Weights of features of (kind, votes, size) by logistic regression on soft labels."""
    weights: dict[tuple, float] = {}
    rows = []
    for kind, *v, size, n in counts:
        f = [("bias",), ("kind", kind), ("size", kind, size), *((KEYS[j], x) for j, x in enumerate(v))]
        rows.append((f, post[kind, *v], n))
    total = sum(n for *_, n in rows) or 1
    grads: dict[tuple, float] = {}
    for _ in range(rounds):  # steps scaled by each weight's past gradients
        step: dict[tuple, float] = {}
        for f, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights.get(x, 0.0) for x in f)))))
            for x in f:
                step[x] = step.get(x, 0.0) + (y - p) * n / total
        for x, g in step.items():
            g -= 1e-4 * weights.get(x, 0.0)
            grads[x] = grads.get(x, 1e-8) + g * g
            weights[x] = weights.get(x, 0.0) + 0.5 * g / math.sqrt(grads[x])
    return weights


def pii_spans(docs: DataFrame, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id), and the spans that stay: row, kind, start, end, span, score, base."""
    rows, spans = candidates(docs)
    spans = stored(votes(spans), "votes")
    counted = spans.groupBy("kind", *KEYS, "size").count().collect()  # at most 81 * 7 rows a kind
    fine = [tuple(r) for r in counted]
    coarse: dict[tuple, int] = {}
    for *v, _size, n in fine:
        coarse[tuple(v)] = coarse.get(tuple(v), 0) + n
    weights = classifier(fine, reliabilities([(*k, n) for k, n in coarse.items()])) if fine else {}
    z = F.lit(weights.get(("bias",), 0.0))
    for kind in PATTERNS:
        mine = F.lit(weights.get(("kind", kind), 0.0))
        for size in range(7):
            mine = mine + F.when(F.col("size") == size, weights.get(("size", kind, size), 0.0)).otherwise(0.0)
        z = z + F.when(F.col("kind") == kind, mine).otherwise(0.0)
    for key in KEYS:
        for x in (-1, 0, 1):
            z = z + F.when(F.col(key) == x, weights.get((key, x), 0.0)).otherwise(0.0)
    spans = spans.select("row", "kind", "start", "end", "span", (1 / (1 + F.exp(-z))).alias("score"), F.col("kind").isin(*BASE).alias("base"))
    w = Window.partitionBy("row").orderBy("start", "end", "kind")
    far = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    near = F.min(F.when(F.col("base"), F.col("start"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    spans = spans.withColumn("free", (far <= F.col("start")) & (near.isNull() | (near >= F.col("end"))))
    return rows, spans.where(F.col("base") | (F.col("free") & (F.col("score") >= threshold))).drop("free")


def pii_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and spans (kind:start:end) of every row."""
    rows, spans = pii_spans(docs, **options)
    order = list(PATTERNS)
    rank = F.lit(len(order))
    for i, kind in enumerate(order):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    mark = F.struct(rank.alias("r"), "start", F.concat_ws(":", "kind", "start", "end").alias("s"))
    join = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x["s"]), ",")
    own = spans.groupBy("row").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE), join(F.collect_list(F.when(F.col("base"), mark))).alias("b"), join(F.collect_list(mark)).alias("spans"))
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE]
    empty = F.lit("")
    return rows.join(own, "row", "left").select("doc_id", *zero, F.sha2(F.coalesce("b", empty).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"))
