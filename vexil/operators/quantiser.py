"""Product quantisation: training, codes, searches over codes, reranking.

A Book has `parts` codebooks of up to 256 centroids, each of a slice of the vector; its size is set by its parameters, not by the data, so it is
sent to every task. Codes are kept as columns of a table and written with the vectors; a search reads the codes, never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.functions.arrays import matrix
from vexil.operators import knn

#: The rows that a codebook is trained on, at most (chosen by a hash of the id).
TRAIN_ROWS = 50_000
CODES = 256
#: Of query tables that are sent to every task at once.
TABLE_BYTES = 64 << 20


@dataclass(frozen=True)
class Book:
    """cells[part, code]: a centroid of the part's slice. rotation: applied to vectors first, or None."""

    cells: np.ndarray
    rotation: np.ndarray | None = None

    @staticmethod
    def of_centroids(centroids: list[list[float]], parts: int) -> "Book":
        rows = np.array(centroids, np.float64)
        if rows.shape[1] % parts:
            raise ValueError(f"{rows.shape[1]} dimensions aren't a multiple of {parts} parts")
        return Book(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())

    def turned(self, v: np.ndarray) -> np.ndarray:
        return v if self.rotation is None else v @ self.rotation.T

    def tables(self, v: np.ndarray, digits: int | None = None) -> np.ndarray:
        """table[row, part, code]: squared distance of the row's slice to each centroid; the differences are squared, not multiplied out."""
        parts = self.turned(v).reshape(len(v), len(self.cells), 1, -1)
        d = ((parts - self.cells[None]) ** 2).sum(3)
        return d if digits is None else np.round(d, digits)

    def encode(self, v: np.ndarray, digits: int | None = None) -> np.ndarray:
        """The nearest centroid's number in each part; ties, after rounding to digits, go to the smaller number."""
        out = np.empty((len(v), len(self.cells)), np.uint8)
        step = max(1, (1 << 22) // max(self.cells.size, 1))
        for i in range(0, len(v), step):
            out[i : i + step] = self.tables(v[i : i + step], digits).argmin(2)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        rows = self.cells[np.arange(len(self.cells))[None], codes].reshape(len(codes), -1)
        return rows if self.rotation is None else rows @ self.rotation

    def symmetric(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squared distances of the centroids that two rows of codes stand for."""
        return ((self.decode(a) - self.decode(b)) ** 2).sum(1)


def _lloyd(v: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k centroids; empty ones are put on the vectors farthest from theirs, and the last step is an update of the centroids."""
    rng = np.random.default_rng(seed)
    means = v[rng.choice(len(v), min(k, len(v)), replace=False)].copy()
    for _ in range(rounds):
        d = (v * v).sum(1)[:, None] + (means * means).sum(1)[None] - 2 * v @ means.T
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(means))
        for j in range(v.shape[1]):
            means[:, j] = np.bincount(at, v[:, j], len(means)) / np.maximum(n, 1)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            means[empty] = v[np.argsort(-d[np.arange(len(v)), at], kind="stable")[: len(empty)]]
    return means


def train(vectors: DataFrame, parts: int, codes: int = CODES, rounds: int = 20, seed: int = 1234, rotation: np.ndarray | None = None, rows: int = TRAIN_ROWS) -> Book:
    """A codebook from all vectors, or from about `rows` of them; each part is trained in a task of its own."""
    if not 1 <= codes <= 256:
        raise ValueError("codes have 8 bits")
    n = vectors.count()
    sample = vectors.select("vec_id", "embedding")
    if n > rows:
        sample = sample.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int(rows / n * (1 << 30)))
    first = sample.select(F.size("embedding").alias("d")).first()
    if first is None:
        raise ValueError("there is nothing to train on")
    dim = first["d"]
    if dim % parts:
        raise ValueError(f"{dim} dimensions aren't a multiple of {parts} parts")
    width = dim // parts

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = matrix(b["embedding"])
            v = (v if rotation is None else v @ rotation.T).reshape(len(b), parts, width)
            for p in range(parts):
                lists = pa.FixedSizeListArray.from_arrays(pa.array(v[:, p].ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), p, np.int32)), b["vec_id"], lists], ["part", "vec_id", "slice"])

    def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(f.sort_values("vec_id")["slice"].to_numpy())
        means = _lloyd(v, codes, rounds, seed + int(key[0]))
        return pd.DataFrame({"part": key[0], "code": range(len(means)), "centroid": list(means)})

    cut = sample.mapInArrow(slices, "part int, vec_id long, slice array<double>")
    made = cut.groupBy("part").applyInPandas(fit, "part int, code int, centroid array<double>").orderBy("part", "code").collect()  # parts * codes rows
    return Book(np.array([r["centroid"] for r in made]).reshape(parts, -1, width), rotation)


def encode(vectors: DataFrame, book: Book, digits: int | None = None) -> DataFrame:
    """vec_id, codes (binary, a byte a part)."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                codes = shared.value.encode(matrix(b["embedding"]), digits)
                yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([x.tobytes() for x in codes], pa.binary())], ["vec_id", "codes"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, codes binary")


def _code_rows(column: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts)


def spelled(codes: DataFrame) -> DataFrame:
    """vec_id, part, code: a row for each part."""
    digits = F.transform(F.sequence(F.lit(1), F.length("codes")), lambda i: F.conv(F.hex(F.substring("codes", i, F.lit(1))), 16, 10).cast("int"))
    return codes.select("vec_id", F.posexplode(digits).alias("part", "code"))


def reconstruct(codes: DataFrame, book: Book) -> DataFrame:
    """vec_id, embedding: the centroids that the codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                v = shared.value.decode(_code_rows(b["codes"], len(shared.value.cells)))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b["vec_id"], lists], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, embedding array<double>")


def adc_search(queries: DataFrame, codes: DataFrame, book: Book, k: int, digits: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, dist: the k nearest by asymmetric distance. Distances are looked up in each query's table, a batch of codes at a time,
    and every batch keeps its k best. Queries whose tables exceed TABLE_BYTES are asked block by block.
    allowed: query_id, vec_id pairs; the others are left out before the cut."""
    blocks = max(1, -(-queries.count() * book.cells.shape[0] * book.cells.shape[1] * 8 // TABLE_BYTES))
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks).cast("long")) == block)
        own = _adc_block(part, codes, book, k, digits, allowed)
        found = own if found is None else found.unionByName(own)
    return knn.top_k(found, k).select("query_id", "rank", "vec_id", "dist")


def _adc_block(queries: DataFrame, codes: DataFrame, book: Book, k: int, digits: int | None, allowed: DataFrame | None) -> DataFrame:
    """query_id, vec_id, dist: the k best of every batch of codes for a block of queries."""
    asked = queries.select("query_id", "q").toPandas()
    parts = len(book.cells)
    if not len(asked):
        return codes.sparkSession.createDataFrame([], "query_id long, vec_id long, dist double")
    tables = book.tables(np.stack(asked["q"].to_numpy()).astype(np.float64))
    shared = codes.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(np.int64), tables))
    rows = codes.select("vec_id", "codes")
    if allowed is not None:
        sets = allowed.join(F.broadcast(queries.select("query_id")), "query_id", "left_semi").groupBy("vec_id").agg(F.collect_set("query_id").alias("for"))
        rows = rows.join(sets, "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tables = shared.value
        place = {q: i for i, q in enumerate(ids.tolist())}
        for whole in batches:
            step = max(64, (4 << 20) // len(ids))
            for i in range(0, len(whole), step):
                b = whole.slice(i, step)
                names, rows = b["vec_id"].to_numpy(), _code_rows(b["codes"], parts)
                d = np.zeros((len(ids), len(names)))
                for p in range(parts):
                    d += tables[:, p][:, rows[:, p]]
                if digits is not None:
                    d = np.round(d, digits)
                if "for" in b.schema.names:
                    free = np.zeros(d.shape, bool)
                    for j, own in enumerate(b["for"].to_pylist()):
                        free[[place[q] for q in own if q in place], j] = True
                    d[~free] = np.inf
                order = np.lexsort((np.broadcast_to(names, d.shape), d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, 1)
                q, j = np.nonzero(best < np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(names[order[q, j]]), pa.array(best[q, j])], ["query_id", "vec_id", "dist"])

    return rows.mapInArrow(run, "query_id long, vec_id long, dist double")


def search(queries: DataFrame, vectors: DataFrame, codes: DataFrame, book: Book, k: int, factor: int = 4, allowed: DataFrame | None = None) -> DataFrame:
    """The k * factor nearest by codes, ranked anew by exact distance."""
    short = adc_search(queries, codes, book, k * factor, allowed=allowed).select("query_id", "vec_id")
    full = F.broadcast(short).join(vectors.select("vec_id", "embedding"), "vec_id") if short.count() <= 1_000_000 else short.join(vectors.select("vec_id", "embedding"), "vec_id")
    return knn.top_k(knn._scored(full.join(queries.select("query_id", "q"), "query_id"), knn.l2_squared), k).select("query_id", "rank", "vec_id", "dist")


def random_rotation(dim: int, seed: int = 7) -> np.ndarray:
    """An orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def distortion(vectors: DataFrame, codes: DataFrame, book: Book) -> float:
    """The mean squared distance of vectors to what their codes stand for."""
    near = reconstruct(codes, book).withColumnRenamed("embedding", "near")
    return vectors.join(near, "vec_id").agg(F.avg(knn.l2_squared(F.col("embedding"), F.col("near"))).alias("m")).first()["m"]
