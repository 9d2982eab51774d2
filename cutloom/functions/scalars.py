"""Scalar helpers as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_floor(x: Column) -> Column:
    """The integer part of log2, exactly; 0 up to 1."""
    return F.when(x <= 1, F.lit(0)).otherwise(F.length(F.bin(x)) - 1)


def num_digits(x: Column) -> Column:
    """Decimal digits; 0 has none."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(x.cast("string")))


def zero_padded(x: Column) -> Column:
    """Padded to the 19 digits of the largest 64-bit integer."""
    return F.lpad(x.cast("string"), 19, "0")


def string_hash(s: Column) -> Column:
    """The sum of all bytes modulo 2^32 (ASCII text)."""
    return F.pmod(F.aggregate(F.transform(F.split(s, ""), F.ascii), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1 << 32))


def random_number(low: int, high: int, seed: int) -> Column:
    """Uniform integers from low up to, but not, high."""
    return (F.floor(F.rand(seed) * (high - low)) + low).cast("long")


def plus(n: Column, w: Column) -> Column:
    return n + w


def edge_either(u: Column, v: Column) -> Column:
    """One end of an undirected edge: the smaller."""
    return F.least(u, v)


def edge_other(u: Column, v: Column, end: Column) -> Column:
    """The end of an edge that `end` is not."""
    return F.when(end == u, v).otherwise(u)


def edge_order(u: Column, v: Column) -> Column:
    """A sort key of edges, by first end and then second."""
    return F.struct(u.alias("u"), v.alias("v"))
