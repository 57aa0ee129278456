"""Product quantisation: a vector becomes one code for each of its slices.

A codebook is a column of arrays: book[part][code] is a centroid of slice `part`. It has a fixed size (parts * codes centroids),
so it travels as a literal or in a broadcast row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexil.functions.distance import l2_squared


def slice_of(v: Column, part: Column, width: int) -> Column:
    return F.slice(v, part * width + 1, F.lit(width))


def tables(v: Column, book: Column, width: int) -> Column:
    """table[part][code]: squared distance of the vector's slice to each centroid of its part."""
    return F.transform(book, lambda cells, part: F.transform(cells, lambda c: l2_squared(slice_of(v, part, width), c)))


def encode(v: Column, book: Column, width: int) -> Column:
    """The nearest centroid's number for every slice; ties go to the smaller number."""
    return F.transform(tables(v, book, width), lambda t: (F.array_position(t, F.array_min(t)) - 1).cast("int"))


def adc(table: Column, codes: Column) -> Column:
    """Asymmetric distance: the sum of table[part][codes[part]]."""
    return F.aggregate(F.zip_with(table, codes, lambda t, c: F.get(t, c)), F.lit(0.0), lambda s, x: s + x)


def reconstruct(codes: Column, book: Column) -> Column:
    return F.flatten(F.zip_with(book, codes, lambda cells, c: F.get(cells, c)))


def symmetric(a: Column, b: Column, book: Column) -> Column:
    """The distance of two codes' centroids."""
    return l2_squared(reconstruct(a, book), reconstruct(b, book))


def residual(v: Column, centroid: Column) -> Column:
    return F.zip_with(v, centroid, lambda x, c: x.cast("double") - c.cast("double"))


def rotate(v: Column, matrix: Column) -> Column:
    """matrix: rows of a rotation."""
    return F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, v, lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x))
