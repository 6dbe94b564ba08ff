"""Projections, predicates, rules, split segments, routing and candidate grids.

Everything is a column expression; nothing here shuffles but ``route`` when it writes.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, ordinals: list[int]) -> DataFrame:
    return df.select(*(df.columns[i] for i in ordinals))


def drop(df: DataFrame, ordinals: list[int]) -> DataFrame:
    gone = {df.columns[i] for i in ordinals}
    return df.select(*(c for c in df.columns if c not in gone))


def predicate(text: str) -> Column:
    """``attr op value [other]``: gt, ge, lt, le, eq, ne; ``attr in v1:v2``.

    The other bound closes the interval on its far side: gt v o is (v, o], ge v o is [v, o), le v o is
    (o, v], lt v o is [o, v).
    """
    attr, op, value, *other = text.split()
    c = F.col(attr)
    if op in ("in", "notin"):
        got = c.cast("string").isin(value.split(":"))
        return got if op == "in" else ~got
    number = F.lit(float(value)) if value.replace(".", "", 1).lstrip("-").isdigit() else F.lit(value)
    got = {"gt": c > number, "ge": c >= number, "lt": c < number, "le": c <= number, "eq": c == number, "ne": c != number}[op]
    if other:
        o = F.lit(float(other[0]))
        got = got & {"gt": c <= o, "ge": c < o, "lt": c >= o, "le": c > o}[op]
    return got


def conjunction(text: str) -> Column:
    return reduce(lambda a, b: a & b, (predicate(x.strip()) for x in text.split(" and ")))


def rule(text: str) -> tuple[Column, str]:
    """``conditions => class``: the condition and the class."""
    cond, _, cls = text.partition("=>")
    return conjunction(cond.strip()), cls.strip()


def first_match(rules: list[str], otherwise: str | None = None) -> Column:
    """Class of the first rule that holds."""
    out = F.lit(otherwise)
    for cond, cls in map(rule, reversed(rules)):
        out = F.when(cond, cls).otherwise(out)
    return out


def segment_of(c: Column, points: list[float]) -> Column:
    """Number of split points strictly below the value."""
    return reduce(lambda a, b: a + b, ((c > p).cast("int") for p in points), F.lit(0))


def group_of(c: Column, groups: list[list]) -> Column:
    """Index of the group that holds the value; null if none does."""
    out = F.lit(None).cast("int")
    for i, g in reversed(list(enumerate(groups))):
        out = F.when(c.isin(g), i).otherwise(out)
    return out


def numeric_points(lo: float, hi: float, step: float, most: int) -> list[tuple[float, ...]]:
    """All sets of 1 .. most - 1 split points on a scan interval, inside (lo, hi)."""
    at, x = [], lo + step
    while x < hi:
        at.append(x)
        x += step
    return [c for k in range(1, most) for c in combinations(at, k)]


def groupings(values: list, most: int) -> list[list[list]]:
    """All ways to part values into 2 .. most groups, each once."""

    def parts(rest: list, groups: list[list]):
        if not rest:
            if 2 <= len(groups) <= most:
                yield [list(g) for g in groups]
            return
        for g in groups:
            g.append(rest[0])
            yield from parts(rest[1:], groups)
            g.pop()
        if len(groups) < most:
            yield from parts(rest[1:], [*groups, [rest[0]]])

    return list(parts(list(values), []))


def route(df: DataFrame, split: int, segment: Column, path: str) -> None:
    """Writes rows to split=i/segment=j."""
    df.withColumn("split", F.lit(split)).withColumn("segment", segment).write.partitionBy("split", "segment").parquet(path)


def partitions(df: DataFrame, predicates: list[list[Column]]) -> DataFrame:
    """Adds ``part``: the number of the combination of predicates, one of each list, that holds."""
    out = F.lit(None).cast("int")
    for i, combo in enumerate(product(*predicates)):
        out = F.when(out.isNull() & reduce(lambda a, b: a & b, combo), i).otherwise(out)
    return df.withColumn("part", out)


def random_halves(df: DataFrame, numeric: list[str], categorical: dict[str, list], seed: int = 1) -> list[list[Column]]:
    """For each column two predicates: below a random point of the middle 60 % of its range or not; in a random subset or not."""
    import numpy as np

    rng = np.random.default_rng(seed)
    r = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in numeric)).first() if numeric else {}
    out = []
    for c in numeric:
        lo, hi = float(r[c]["lo"]), float(r[c]["hi"])
        p = lo + (hi - lo) * (0.2 + 0.6 * rng.random())
        out.append([F.col(c) < p, F.col(c) >= p])
    for c, values in categorical.items():
        some = [values[i] for i in sorted(rng.choice(len(values), int(rng.integers(1, len(values))), replace=False))]
        out.append([F.col(c).isin(some), ~F.col(c).isin(some)])
    return out


def shift_scale(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    """(column + shift) * scale."""
    return df.withColumns({c: (F.col(c) + s) * k for c, (s, k) in by.items()})


def candidate_grid(df: DataFrame, features: dict[str, list]) -> DataFrame:
    """Each row, tagged R, and its copies over all combinations of feature values, tagged G."""
    g = df
    for c, values in features.items():
        g = g.withColumn(c, F.explode(F.array(*(F.lit(v).cast(df.schema[c].dataType) for v in values))))
    return df.withColumn("kind", F.lit("R")).unionByName(g.withColumn("kind", F.lit("G")))


def change_cost(df: DataFrame, other: str, this: str, numeric: dict[str, float], categorical: dict[str, dict[tuple, float]]) -> Column:
    """Cost of changing one row into another (struct columns): a price a unit of change, or of each pair of values."""
    total = F.lit(0.0)
    for c, price in numeric.items():
        total = total + F.abs(F.col(f"{other}.{c}") - F.col(f"{this}.{c}")) * price
    for c, prices in categorical.items():
        x = F.lit(0.0)
        for (a, b), price in prices.items():
            x = F.when((F.col(f"{this}.{c}") == a) & (F.col(f"{other}.{c}") == b), price).otherwise(x)
        total = total + x
    return total


def sublists(items: Column, most: int) -> Column:
    """All sublists of 1 .. most distinct items of an array, in order."""
    one = F.transform(items, lambda x: F.array(x))
    out, last = one, one
    for _ in range(1, most):
        last = F.flatten(F.transform(last, lambda s: F.transform(F.filter(items, lambda x: F.array_position(items, x) > F.array_position(items, F.element_at(s, -1))), lambda x: F.concat(s, F.array(x)))))
        out = F.concat(out, last)
    return out
