"""Scalar functions of the engine, all within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scatter(vid: Column, salt: Column | int) -> Column:
    """A fixed pseudo-random number of a vertex, the same in any SQL engine."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return ((vid + 1) * F.lit(2654435761) + salt * F.lit(40503)) % F.lit(1000003)


def linf(a: Column, b: Column) -> Column:
    """The largest difference of two vectors' components."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def one_sided(a: Column, b: Column) -> Column:
    """The largest of a - b, or 0."""
    return F.greatest(F.array_max(F.zip_with(a, b, lambda x, y: x - y)), F.lit(0))


def number(cell: Column) -> Column:
    """The integer that a cell of a text file begins with, or 0."""
    return F.coalesce(F.regexp_extract(cell, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def nearest_gap(values: Column, x: Column) -> Column:
    """How far x is from the nearest of an array of values."""
    return F.array_min(F.transform(values, lambda v: F.abs(v - x)))
