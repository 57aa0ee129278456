"""Distances of two vector columns (arrays of floats), summed in double precision in the arrays' order.

Null vectors give null. Vectors of different lengths are an error of the caller; the longer one's surplus makes the result null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Distance = Callable[[Column, Column], Column]


def _total(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _pairwise(a: Column, b: Column, term: Distance) -> Column:
    return F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _total(_pairwise(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _total(_pairwise(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """Zero vectors give nulls."""
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


def inner_product(a: Column, b: Column) -> Column:
    """One less the inner product, so that nearer is smaller."""
    return 1 - dot(a, b)


def cosine(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def l1(a: Column, b: Column) -> Column:
    return _total(_pairwise(a, b, lambda x, y: F.abs(x - y)))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(_pairwise(a, b, lambda x, y: F.abs(x - y)))


def lp(p: float) -> Distance:
    def metric(a: Column, b: Column) -> Column:
        return F.pow(_total(_pairwise(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p))

    metric.power = p
    return metric


def canberra(a: Column, b: Column) -> Column:
    return _total(_pairwise(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))))


def bray_curtis(a: Column, b: Column) -> Column:
    return F.try_divide(l1(a, b), _total(_pairwise(a, b, lambda x, y: F.abs(x + y))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of two non-negative vectors; terms of zero count for nothing."""
    part = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return 0.5 * _total(_pairwise(a, b, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2)))


def jaccard(a: Column, b: Column) -> Column:
    """One less the sum of minima over the sum of maxima."""
    return 1 - F.try_divide(_total(_pairwise(a, b, lambda x, y: F.least(x, y))), _total(_pairwise(a, b, lambda x, y: F.greatest(x, y))))


METRICS: dict[str, Distance] = {
    "l2": l2_squared, "ip": inner_product, "cosine": cosine, "l1": l1, "linf": linf, "l3": lp(3), "canberra": canberra,
    "bray_curtis": bray_curtis, "jensen_shannon": jensen_shannon, "jaccard": jaccard,
}
