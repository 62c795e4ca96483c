"""Vector functions as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    # the length is an item of an array, since within a function of the elements it would be computed for each of them
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))), F.lit(0))


def hash_bucket(term: Column, dim: int) -> Column:
    """The bucket of a term: the first four bytes of its SHA-256, big-endian, modulo dim."""
    return F.conv(F.substring(F.sha2(term, 256), 1, 8), 16, 10).cast("long") % dim


def hash_sign(term: Column) -> Column:
    """1 if the fifth byte is even, else -1."""
    byte = F.conv(F.substring(F.sha2(term, 256), 9, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 0, 1.0).otherwise(-1.0)
