"""Vector algebra on array columns, in double precision; all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    """Sum of the elements, from first to last."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it, also inside its own lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has the length 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def normalized(a: Column) -> Column:
    """Of length 1; null for the zero vector."""
    return bound(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)))


def standardized(a: Column) -> Column:
    """Less the mean, over the population's deviation; null for constant vectors."""
    centred = bound(total(a) / F.size(a), lambda mean: F.transform(a, lambda x: x - mean))
    return bound(centred, lambda c: bound(F.sqrt(dot(c, c) / F.size(c)), lambda d: F.when(d > 0, F.transform(c, lambda x: x / d))))


def times(matrix: Column, v: Column) -> Column:
    """Matrix (rows of arrays) times vector."""
    return F.transform(matrix, lambda row: dot(row, v))


def identity(d: int) -> Column:
    at = F.sequence(F.lit(0), F.lit(d - 1))
    return F.transform(at, lambda i: F.transform(at, lambda j: (i == j).cast("double")))


def mahalanobis(x: Column, centre: Column, inverse: Column | None = None) -> Column:
    """Distance under an inverse covariance; without one, the Euclidean distance."""
    d = subtract(x, centre)
    return F.sqrt(dot(d, times(inverse, d)) if inverse is not None else dot(d, d))


def inverse2(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Column]:
    """Inverse of ((a, b), (c, d)); nulls where the determinant is 0."""
    det = a * d - b * c
    over = F.when(det != 0, F.lit(1.0) / det)
    return d * over, -b * over, -c * over, a * over
