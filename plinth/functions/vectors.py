"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    # Over an array of the norm alone: inside the function of a transform it would be computed for each element.
    scaled = lambda n: F.when(n == 0, F.transform(a, lambda x: F.lit(0.0))).otherwise(F.transform(a, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)
