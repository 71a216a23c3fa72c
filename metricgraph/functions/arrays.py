"""Linear algebra on array columns and on small matrices of columns. Everything stays inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A metric: coordinate columns to the rows of a symmetric matrix of columns.
Metric = Callable[[Sequence[Column]], Sequence[Sequence[Column]]]


def total(a: Column) -> Column:
    """Sum of an array of doubles; 0.0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity. Equal vectors give 1.0, zero vectors included; a zero vector against another gives null."""
    return F.when(a == b, F.lit(1.0)).otherwise(F.try_divide(dot(a, b), norm(a) * norm(b)))


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def squared_deviation(a: Column) -> Column:
    """Sum of squared deviations from the array's own mean."""
    return total(F.transform(a, lambda x: (x - mean(a)) * (x - mean(a))))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def quadratic(g: Sequence[Sequence[Column]], d: Sequence[Column]) -> Column:
    """dT g d for a matrix and a vector of columns."""
    terms = [d[i] * g[i][j] * d[j] for i in range(len(d)) for j in range(len(d))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def det2(g: Sequence[Sequence[Column]]) -> Column:
    return g[0][0] * g[1][1] - g[0][1] * g[1][0]


def inverse2(g: Sequence[Sequence[Column]]) -> list[list[Column]]:
    """Inverse of a 2 x 2 matrix of columns; nulls where it is singular."""
    d = det2(g)
    return [[F.try_divide(g[1][1], d), F.try_divide(-g[0][1], d)], [F.try_divide(-g[1][0], d), F.try_divide(g[0][0], d)]]


def matrix_of(g: Column, dims: int) -> list[list[Column]]:
    """A row-major array column as rows of columns."""
    return [[F.get(g, F.lit(i * dims + j)) for j in range(dims)] for i in range(dims)]


def flat(g: Sequence[Sequence[Column]]) -> Column:
    """A matrix of columns as a row-major array column."""
    return F.array(*(x.cast("double") for row in g for x in row))


def coords(point: Column, dims: int) -> list[Column]:
    return [F.get(point, F.lit(i)) for i in range(dims)]
