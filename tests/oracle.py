"""Runs queries beside their SQL in DuckDB.  python tests/oracle.py [DIR] [NAME...]: a line for each query."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(0.0 if x == 0 else x)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "asDict"):
        return plain(list(x))
    if type(x).__name__ == "Decimal":
        return plain(float(x))
    return x if isinstance(x, (int, str, bool, type(None))) else str(x)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in rows))


def difference(spark, con, sf_dir: str, f, sql: str | None) -> str:
    """Empty if the query gives what its SQL gives."""
    df = f(spark, sf_dir)
    cols, got = rows_of(df.columns, df.collect())
    if sql is None:
        return ""
    r = con.execute(sql)
    names, want = rows_of([d[0] for d in r.description], r.fetchall())
    if cols != names:
        return f"columns {cols} against {names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    odd = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(odd)} of {len(got)} rows differ, first {odd[0]}" if odd else ""


def session(cpus: int):
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def main(args: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf_dir, names = (args[0] if args else "/root/testdata/sf0.01"), args[1:]
    q, o = entry.queries(), entry.oracle_sql()
    spark, con, bad = session(int(os.environ.get("CPUS", "4"))), connect(sf_dir), 0
    for name in names or q:
        t = time.time()
        try:
            said = difference(spark, con, sf_dir, q[name], o.get(name))
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        print(f"{name} {time.time() - t:.1f}s {'FAIL ' + said[:900] if said else 'ok' if name in o else 'rows only'}", flush=True)
    print(f"{bad} bad of {len(names or q)}; {len(q)} queries, {len(o)} with SQL")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
