"""Scalar functions as column expressions: parsing, strings, time, arithmetic, arrays, maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bandits import hashed


def kind_of(c: Column) -> Column:
    """int, float, boolean, none or string: the first that a text fits."""
    t = F.trim(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), "int").when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").when(F.lower(t).isin("true", "false"), "boolean").when(F.lower(t).isin("none", "null"), "none").otherwise("string")


def is_number(c: Column) -> Column:
    return F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def formatted(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def split_once(c: Column, sep: str) -> tuple[Column, Column]:
    """What stands before the first separator, and after it (null without one)."""
    at = F.instr(c, sep)
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c), F.when(at > 0, F.substr(c, at + len(sep)))


def trimmed(c: Column, n: int) -> Column:
    """Without n characters at either end."""
    return F.substr(c, F.lit(n + 1), F.greatest(F.lit(0), F.length(c) - 2 * n))


def mutated(c: Column, times: int, seed: int = 1) -> Column:
    """Characters replaced at places that a hash chooses: letters by letters, digits by digits."""
    out = c
    for k in range(times):
        h = hashed(seed + k, c)
        at = (F.pmod(h, F.greatest(F.length(c), F.lit(1))) + 1).cast("int")
        old = F.substr(out, at, F.lit(1))
        new = F.when(old.rlike("[0-9]"), F.char(F.lit(48) + F.pmod(F.shiftright(h, 8), F.lit(10)))).when(old.rlike("[A-Za-z]"), F.char(F.lit(97) + F.pmod(F.shiftright(h, 8), F.lit(26)))).otherwise(old)
        out = F.concat(F.substr(out, F.lit(1), at - 1), new, F.substr(out, at + 1, F.length(out)))
    return out


def aligned(seconds: Column, unit: int) -> Column:
    """Epoch seconds floored to a multiple of a unit: 60, 300, 3600, 86400."""
    return F.floor(seconds / unit) * unit


def hour_anchor(seconds: Column, hour: int) -> Column:
    """The latest instant not after it whose hour of day is the one given."""
    day = aligned(seconds - hour * 3600, 86400)
    return day + hour * 3600


def day_of_week(seconds: Column) -> Column:
    """0 is Thursday, the day of epoch 0."""
    return F.floor(F.pmod(seconds, F.lit(7 * 86400)) / 86400).cast("int")


def hour_of_day(seconds: Column) -> Column:
    return F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")


def month_of_year(seconds: Column) -> Column:
    """By months of a twelfth of 365 days."""
    return F.floor(F.pmod(seconds, F.lit(365 * 86400)) / (365 * 86400 / 12)).cast("int")


def weighted_average(values: Column, weights: Column) -> Column:
    plus = lambda a, x: a + x
    return F.aggregate(F.zip_with(values, weights, lambda v, w: (v * w).cast("double")), F.lit(0.0), plus) / F.aggregate(F.transform(weights, lambda w: w.cast("double")), F.lit(0.0), plus)


def parabola(x: tuple[float, float, float], y: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """a, b, c of a x^2 + b x + c through three points."""
    (p, q, r), (u, v, w) = x, y
    a = (u * (q - r) + v * (r - p) + w * (p - q)) / ((p - q) * (p - r) * (q - r))
    b = (v - u) / (q - p) - a * (p + q)
    return a, b, u - a * p * p - b * p


def harmonic(n: Column) -> Column:
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s + 1 / i)).otherwise(0.0)


def digamma(n: Column) -> Column:
    return harmonic(n - 1) - 0.577216


def norm(values: Column, p: float = 2.0) -> Column:
    """The vector over its p-norm."""
    total = F.pow(F.aggregate(values, F.lit(0.0), lambda s, v: s + F.pow(F.abs(v), F.lit(p))), F.lit(1 / p))
    return F.transform(values, lambda v: v / total)


def minkowski(a: Column, b: Column, p: float) -> Column:
    return F.pow(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(F.abs(x.cast("double") - y.cast("double")), F.lit(p))), F.lit(0.0), lambda s, v: s + v), F.lit(1 / p))


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def binary_code(index: Column, bits: int) -> Column:
    """Digits of the index in base two, the greatest first."""
    return F.transform(F.sequence(F.lit(bits - 1), F.lit(0)), lambda i: F.pmod(F.floor(index / F.pow(F.lit(2.0), i)), F.lit(2)).cast("int"))


def binned(c: Column, low: float, width: float) -> Column:
    return F.floor((c - low) / width).cast("int")


def ranks(values: Column) -> Column:
    """Place of each value among the array's values, from 0; equals share the first."""
    return F.transform(values, lambda v: F.size(F.filter(values, lambda x: x < v)))


def int_ranges(c: Column) -> Column:
    """'1,3:5' to [1, 3, 4, 5]."""
    part = lambda x: F.when(x.contains(":"), F.sequence(F.split_part(x, F.lit(":"), F.lit(1)).cast("int"), F.split_part(x, F.lit(":"), F.lit(2)).cast("int"))).otherwise(F.array(x.cast("int")))
    return F.flatten(F.transform(F.split(c, ","), part))


def without_nan(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v))


def greatest_gap(values: Column) -> Column:
    """Between neighbours of a sorted array."""
    s = F.array_sort(values)
    n = F.size(s)
    return F.when(n > 1, F.array_max(F.zip_with(F.slice(s, 2, n - 1), F.slice(s, 1, n - 1), lambda b, a: b - a)))


def chunks(values: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda i: F.slice(values, i * size + 1, size))


def add_to_map(m: Column, key: Column, n: Column) -> Column:
    """A keyed counter with n added to one key."""
    return F.map_zip_with(m, F.create_map(key, n), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def past_interval(now: Column, n: int, unit: str) -> Column:
    """(begin, end): from so many seconds, minutes, hours or days (s, m, h, d) before a time up to it; epoch seconds."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {sorted(UNITS)}")
    return F.struct((now - n * UNITS[unit]).alias("begin"), now.alias("end"))
