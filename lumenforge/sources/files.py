"""Delimited text, JSON feature schemas, model and per-length outputs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"string": "string", "categorical": "string", "text": "string", "int": "int", "long": "long", "double": "double", "float": "double", "date": "date"}


@dataclass(frozen=True)
class Field:
    name: str
    ordinal: int
    dataType: str = "string"
    id: bool = False
    feature: bool = False
    classAttribute: bool = False
    cardinality: tuple = ()
    min: float | None = None
    max: float | None = None
    bucketWidth: float | None = None
    splitScanInterval: float | None = None
    maxSplit: int | None = None

    @property
    def ddl(self) -> str:
        return f"`{self.name}` {TYPES[self.dataType]}"


def feature_schema(text: str) -> list[Field]:
    """Fields of a JSON document with a list ``fields``, by ordinal."""
    known = Field.__dataclass_fields__
    got = [Field(**{k: tuple(v) if isinstance(v, list) else v for k, v in f.items() if k in known}) for f in json.loads(text)["fields"]]
    return sorted(got, key=lambda f: f.ordinal)


def read_delimited(spark: SparkSession, path: str, fields: list[Field], delim: str = ",") -> DataFrame:
    """Text without header or quoting, fields trimmed; places without a field are skipped."""
    width = max(f.ordinal for f in fields) + 1
    by = {f.ordinal: f for f in fields}
    ddl = ", ".join(by[i].ddl if i in by else f"`_{i}` string" for i in range(width))
    df = spark.read.schema(ddl).option("sep", delim).option("quote", "").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.select(*(f.name for f in fields))


def bucketed(field: Field) -> Column:
    return F.floor(F.col(field.name) / field.bucketWidth) if field.bucketWidth else F.col(field.name)


def write_delimited(df: DataFrame, path: str, delim: str = ",") -> None:
    """Text without header or quoting; a null is an empty field."""
    df.select(F.concat_ws(delim, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.text(path)


def write_by_length(df: DataFrame, path: str, column: str = "itemset_len") -> None:
    df.write.partitionBy(column).parquet(path)


def predict_with(df: DataFrame, f, ddl: str) -> DataFrame:
    """Scores batches by a local function of a pandas frame, in place of a remote service."""

    def run(it):
        for b in it:
            yield f(b)

    return df.mapInPandas(run, ddl)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """name, text: each file of a folder whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def options_from_properties(text: str, defaults: dict) -> dict:
    """``key=value`` lines over defaults, each value read as the default's type; a key whose default is None must be there."""
    given = dict(line.split("=", 1) for line in map(str.strip, text.splitlines()) if line and not line.startswith("#"))
    given = {k.strip(): v.strip() for k, v in given.items()}
    unknown = set(given) - set(defaults)
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    missing = [k for k, v in defaults.items() if v is None and k not in given]
    if missing:
        raise ValueError(f"missing keys {missing}")

    def read(k: str, d):
        v = given.get(k)
        if v is None or v == "_":
            return d
        if isinstance(d, bool):
            return v.lower() == "true"
        if isinstance(d, list):
            return [type(d[0])(x) if d else x for x in v.split(",")]
        return v if d is None else type(d)(v)

    return {k: read(k, d) for k, d in defaults.items()}


def write_paths(paths: list[dict], spark: SparkSession, path: str) -> None:
    """Decision paths (see ``models.grow_tree``) as JSON lines in one folder."""
    spark.createDataFrame([(json.dumps(p, sort_keys=True),) for p in paths], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_paths(spark: SparkSession, path: str) -> list[dict]:
    """A tree's paths: as many as the tree has leaves."""
    return [json.loads(r["value"]) for r in spark.read.text(path).collect()]


def predict_paths(paths: list[dict], otherwise: float | None = None) -> Column:
    """Class probability of the first path whose predicates all hold."""
    out = F.lit(otherwise).cast("double")
    for p in reversed(paths):
        out = F.when(F.expr(p["path"]) if p["path"] else F.lit(True), F.lit(float(p["prob"]))).otherwise(out)
    return out


def stream(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    """A stream by its format's name: rate, socket, kafka (its package given to the session), or files with a schema."""
    schema = options.pop("schema", None)
    r = spark.readStream.format(kind).options(**options)
    return (r.schema(schema) if schema else r).load()


def read_hocon(text: str) -> dict:
    """Nested settings: ``key = value`` or ``key : value`` lines, ``key { ... }`` blocks, lists, quoted strings, # and // comments.

    Dotted keys nest; numbers and true, false and null are read as such; ${a.b} stands for a value before it.
    """
    import re

    space, stop = r"[^\S\n]*", r"{}\[\],=:\n#"
    token = re.compile(rf"""{space}(?:(?:\#|//)[^\n]*|("(?:[^"\\]|\\.)*")|(\$\{{[^}}]*\}})|([{{}}\[\],=:\n])|([^\s{stop}"](?:(?!//)[^{stop}])*))""")
    marks = [(next(filter(None, m.groups())), bool(m[1])) for m in token.finditer(text) if any(m.groups())]
    root: dict = {}
    at = 0

    def look(path: str):
        out = root
        for k in path.split("."):
            out = out[k]
        return out

    def plain(word: str, quoted: bool):
        if quoted:
            return json.loads(word)
        word = word.strip()
        if word.startswith("${") or word in ("true", "false", "null"):
            return look(word[2:-1]) if word[0] == "$" else json.loads(word)
        for kind in (int, float):
            try:
                return kind(word)
            except ValueError:
                pass
        return word

    def skip():
        nonlocal at
        while at < len(marks) and marks[at][0] in ("\n", ","):
            at += 1

    def value():
        nonlocal at
        word, quoted = marks[at]
        at += 1
        if word == "{":
            return block({}, "}")
        if word == "[":
            out: list = []
            skip()
            while marks[at][0] != "]":
                out.append(value())
                skip()
            at += 1
            return out
        return plain(word, quoted)

    def block(out: dict, end: str | None) -> dict:
        nonlocal at
        skip()
        while at < len(marks) and marks[at][0] != end:
            word, quoted = marks[at]
            key = [json.loads(word)] if quoted else word.strip().split(".")
            at += 1
            if marks[at][0] in ("=", ":"):
                at += 1
            inner = out
            for k in key[:-1]:
                inner = inner.setdefault(k, {})
            got = value()
            inner[key[-1]] = inner[key[-1]] | got if isinstance(got, dict) and isinstance(inner.get(key[-1]), dict) else got
            skip()
        at += 1
        return out

    return block(root, None)


def setting(settings: dict, key: str, kind: type, otherwise=..., needed_if: bool = True):
    """A dotted key's value, of its kind; without it ``otherwise``, or an error if it is needed."""
    out = settings
    for k in key.split("."):
        if not isinstance(out, dict) or k not in out:
            if otherwise is not ... or not needed_if:
                return None if otherwise is ... else otherwise
            raise ValueError(f"missing setting {key}")
        out = out[k]
    if kind is float and isinstance(out, int) and not isinstance(out, bool):
        out = float(out)
    if not isinstance(out, kind) or isinstance(out, bool) and kind is not bool:
        raise ValueError(f"{key} is not {kind.__name__}: {out!r}")
    return out


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets))


def write_keyed(df: DataFrame, key: str, path: str, buckets: int = 64) -> None:
    """A store for look-ups by key: a folder for each bucket of keys, rows in order of the key within a file."""
    d = df.withColumn("bucket", _bucket(F.col(key), buckets))
    d.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)


def look_up(spark: SparkSession, path: str, key: str, value, buckets: int = 64) -> DataFrame:
    """The rows of one key: one folder is read, and of its files the row groups that may hold the key."""
    bucket = int(spark.range(1).select(_bucket(F.lit(value), buckets).alias("b")).first()["b"])
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col(key) == value)).drop("bucket")


def send_rows(df: DataFrame, connect) -> int:
    """Sends each row to an outside store, by a client of its own for each task; gives how many were sent.

    connect(): an object with send(row: dict) and close(); a lost task sends its rows again.
    """

    def run(it):
        import pandas as pd

        client, n = connect(), 0
        try:
            for b in it:
                for row in b.to_dict("records"):
                    client.send(row)
                    n += 1
        finally:
            client.close()
        yield pd.DataFrame({"n": [n]})

    return df.mapInPandas(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0  # a number for each task


def write_two(df: DataFrame, main: str, side: str, to_side: Column) -> None:
    """Two outputs of one result: rows where to_side holds go to the second place."""
    held = df.withColumn("_side", F.coalesce(to_side, F.lit(False)))
    held.where(~F.col("_side")).drop("_side").write.parquet(main)
    held.where("_side").drop("_side").write.parquet(side)
