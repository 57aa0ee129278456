"""Id selectors, as objects that compile to a condition below the search: ranges, lists, tables of ids, bitmaps, labels, callbacks and their combinations.

A selector is applied to a table with vec_id before anything is scored. Small ones become plain conditions; tables of ids become semi-joins
(Spark filters them by a Bloom filter of its own where that pays); bitmaps are joined by bucket and tested bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.operators.access import bitmaps


@dataclass(frozen=True)
class Selector:
    """mark(rows, name) adds a boolean column by that name."""

    mark: Callable[[DataFrame, str], DataFrame]

    def __and__(self, other: "Selector") -> "Selector":
        return _both(self, other, lambda a, b: a & b)

    def __or__(self, other: "Selector") -> "Selector":
        return _both(self, other, lambda a, b: a | b)

    def __xor__(self, other: "Selector") -> "Selector":
        return _both(self, other, lambda a, b: a != b)

    def __invert__(self) -> "Selector":
        return Selector(lambda rows, name: self.mark(rows, name).withColumn(name, ~F.col(name)))

    def filter(self, rows: DataFrame) -> DataFrame:
        return self.mark(rows, "__chosen").where("__chosen").drop("__chosen")


def _both(a: Selector, b: Selector, how: Callable[[Column, Column], Column]) -> Selector:
    def mark(rows: DataFrame, name: str) -> DataFrame:
        left, right = f"{name}l", f"{name}r"
        return b.mark(a.mark(rows, left), right).withColumn(name, how(F.col(left), F.col(right))).drop(left, right)

    return Selector(mark)


def where(condition: Column) -> Selector:
    """Any condition over the table's columns; null counts as false."""
    return Selector(lambda rows, name: rows.withColumn(name, F.coalesce(condition, F.lit(False))))


def everything() -> Selector:
    return where(F.lit(True))


def id_range(low: int, high: int) -> Selector:
    """low to high - 1."""
    return where((F.col("vec_id") >= low) & (F.col("vec_id") < high))


def id_list(ids: list[int]) -> Selector:
    return where(F.col("vec_id").isin(list(ids)) if ids else F.lit(False))


def id_table(ids: DataFrame) -> Selector:
    """ids: vec_id. Of any size."""
    known = ids.select(F.col("vec_id").alias("__known")).distinct()
    return Selector(lambda rows, name: rows.join(known, F.col("vec_id") == F.col("__known"), "left").withColumn(name, F.col("__known").isNotNull()).drop("__known"))


def id_bitmap(packed: DataFrame) -> Selector:
    """packed: bucket, bitmap (of 32768 ids each, from 1 on, as access.bitmaps makes them)."""
    maps = packed.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap"))

    def mark(rows: DataFrame, name: str) -> DataFrame:
        place = F.bitmap_bit_position("vec_id").cast("int")
        byte = F.conv(F.hex(F.substring("__bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        joined = rows.join(maps, F.bitmap_bucket_number("vec_id") == F.col("__bucket"), "left")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, place % 8) == 1, F.lit(False))).drop("__bucket", "__bitmap")

    return Selector(mark)


def label(access: DataFrame, tid: int) -> Selector:
    return id_table(access.where(F.col("tid") == tid))


def label_bitmap(access: DataFrame, tid: int) -> Selector:
    return id_bitmap(bitmaps(access.where(F.col("tid") == tid)).select("bucket", "bitmap"))


def callback(f: Callable[[pd.Series], pd.Series], column: str) -> Selector:
    """A function of a metadata column's values, a batch at a time, that says which rows count."""
    test = F.pandas_udf(f, "boolean")
    return Selector(lambda rows, name: rows.withColumn(name, F.coalesce(test(F.col(column)), F.lit(False))))
