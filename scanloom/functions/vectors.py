"""Dense vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a norm of zero.
TINY = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def norm(a: Column) -> Column:
    """Length; a zero vector has the length sqrt(1e-11)."""
    squared = squared_norm(a)
    return F.sqrt(F.when(squared == 0, F.lit(1e-11)).otherwise(squared))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalise(a: Column) -> Column:
    """a divided by its length, or by TINY where that is zero."""
    length = F.sqrt(squared_norm(a))
    return F.get(
        F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(TINY)).otherwise(n))), F.lit(0)
    )


def concat(*parts: Column) -> Column:
    return F.concat(*parts)
