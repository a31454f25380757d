"""Similarities and distances of numeric arrays, as expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _wide(x: Column) -> Column:
    return x.cast("array<double>")


def fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def squared(a: Column, b: Column) -> Column:
    return fold(F.zip_with(_wide(a), _wide(b), lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return fold(F.zip_with(_wide(a), _wide(b), lambda x, y: F.abs(x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def strict(f):
    """Raises if the arrays differ in length."""
    return lambda a, b: F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(f(a, b))


def lenient(f):
    """0 if the arrays differ in length or are empty."""
    return lambda a, b: F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(f(a, b))


def cosine(a: Column, b: Column, of_zero: float) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(of_zero)).otherwise(dot(a, b) / F.when(n != 0, n))


def cross(a: Column, b: Column) -> Column:
    at = lambda v, i: F.element_at(_wide(v), i + 1)
    term = lambda i, j: at(a, i) * at(b, j) - at(a, j) * at(b, i)
    return F.when((F.size(a) == 3) & (F.size(b) == 3), F.array(term(1, 2), term(2, 0), term(0, 1))).otherwise(F.raise_error(F.lit("the cross product needs three dimensions")).cast("array<double>"))


FUNCTIONS = {
    "array_cosine_similarity": strict(lambda a, b: cosine(a, b, 1.0)),
    "array_distance": strict(lambda a, b: F.sqrt(squared(a, b))),
    "array_inner_product": strict(dot),
    "array_dot_product": strict(dot),
    "array_squared_distance": strict(squared),
    "array_cross_product": cross,
    "cosine_similarity": lenient(lambda a, b: cosine(a, b, 0.0)),
    "euclidean_distance": lenient(lambda a, b: F.sqrt(squared(a, b))),
    "l2_distance": lenient(squared),
    "dot_product": lenient(dot),
}
