"""Truth files: true neighbours of queries as text, as counted binary files and as .ivecs; all become query_id, rank, vec_id.

Ids below zero are padding and left out. `k` keeps the first k of each row; a row with fewer ids raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.sources.formats import number_rows

_TRUTH = "query_id long, rank int, vec_id long"


def _long(rows: np.ndarray, k: int | None, first: int = 0) -> pd.DataFrame:
    if k is not None and rows.shape[1] < k:
        raise ValueError(f"rows have {rows.shape[1]} ids, not {k}")
    rows = rows[:, :k]
    n, width = rows.shape
    out = pd.DataFrame({"query_id": np.repeat(np.arange(first, first + n), width), "rank": np.tile(np.arange(1, width + 1, dtype=np.int32), n), "vec_id": rows.ravel().astype(np.int64)})
    return out[out["vec_id"] >= 0]


def _binary(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield from parse(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _TRUTH)


def read_ivecs(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Records of an int32 length and so many int32 ids; records may differ in length."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        words, at, query = np.frombuffer(content, "<i4"), 0, 0
        while at < len(words):
            n = int(words[at])
            if at + 1 + n > len(words):
                raise ValueError("a record is cut off")
            yield _long(words[at + 1 : at + 1 + n][None], k, query)
            at, query = at + 1 + n, query + 1

    return _binary(spark, path, parse)


def read_counted(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """Two int32 (rows, ids a row) and all ids."""

    def parse(content: bytes) -> Iterator[pd.DataFrame]:
        n, width = (int(x) for x in np.frombuffer(content, "<i4", 2))
        rows = np.frombuffer(content, "<i4", n * width, 8).reshape(n, width)
        for i in range(0, n, 10_000):
            yield _long(rows[i : i + 10_000], k, i)

    return _binary(spark, path, parse)


def read_text(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """A line of ids, parted by blanks, for each query, in the order of the (single) file."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    ids = F.split(F.trim("value"), r"\s+")
    rows = number_rows(lines, "at", name="query_id").select("query_id", F.transform(ids, lambda x: x.cast("long")).alias("ids"))
    if k is not None:
        short = F.raise_error(F.concat(F.lit("too few ids for query "), F.col("query_id").cast("string")))
        rows = rows.select("query_id", F.when(F.size("ids") >= k, F.slice("ids", 1, k)).otherwise(F.array(short.cast("long"))).alias("ids"))
    return rows.select("query_id", F.posexplode("ids").alias("pos", "vec_id")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "vec_id").where("vec_id >= 0")


def write_text(truth: DataFrame, path: str, k: int) -> None:
    """A line for each query, in order of query_id; short rows are padded with -1."""
    rows = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("rank", "vec_id"))).alias("m"))
    ids = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(-1).cast("long")).cast("string"))
    rows.orderBy("query_id").coalesce(1).select(F.array_join(ids, " ").alias("value")).write.mode("overwrite").text(path)


READERS = {"txt": read_text, "default": read_counted, "xvec": read_ivecs}


def read(spark: SparkSession, path: str, kind: str, k: int | None = None) -> DataFrame:
    if kind.lower() not in READERS:
        raise ValueError(f"unknown kind {kind!r}")
    return READERS[kind.lower()](spark, path, k)
