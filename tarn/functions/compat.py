"""SQL functions that Spark has under another name or not at all, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of longs: Euclid's steps, of which 64-bit numbers need 92 at most."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    """Least common multiple of longs; 0 if either is 0."""
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise((F.abs(a.cast("long")) / gcd(a, b)).cast("long") * F.abs(b.cast("long")))


def trunc_number(x: Column) -> Column:
    """Towards zero."""
    return F.signum(x) * F.floor(F.abs(x))


def iszero(x: Column) -> Column:
    return x == 0


def strpos(text: Column, part: str) -> Column:
    """Place of the first occurrence from 1; 0 if there is none."""
    return F.instr(text, part)


def to_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def regexp_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, which may be empty; null if there is none."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def date_bin(seconds: int, ts: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """Start of the bin of so many seconds, counted from the origin."""
    zero = F.lit(origin).cast("timestamp").cast("long")
    return F.timestamp_seconds(F.floor((F.unix_micros(ts.cast("timestamp")) / 1e6 - zero) / seconds) * seconds + zero)


def day_of_week(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def array_has_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def array_slice(a: Column, first: int, last: int) -> Column:
    """Elements first to last, both counted from 1."""
    return F.slice(a, first, last - first + 1)


def array_pop_back(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def array_pop_front(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))


def array_replace(a: Column, old, new) -> Column:
    return F.transform(a, lambda x: F.when(x == F.lit(old), F.lit(new)).otherwise(x))


def array_resize(a: Column, size: int, fill) -> Column:
    """Cut or filled up to a size."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(fill), size)), 1, size)
