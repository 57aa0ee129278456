"""Vector files and result files. Binary files are read whole by Spark's own reader and parsed in the tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexil.lineage import cut

#: The element types that .npy files may hold.
NPY_TYPES = ("float32", "int32", "int64", "uint8")
_VECTORS = "vec_id long, embedding array<float>"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (row of its file), embedding of a matrix; a file's rows leave its task in batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.dtype.name not in NPY_TYPES:
                    raise ValueError(f"{a.dtype} isn't read")
                a = a.reshape(len(a), -1)
                for i in range(0, len(a), 10_000):
                    yield pd.DataFrame({"vec_id": np.arange(i, min(i + 10_000, len(a))), "embedding": list(a[i : i + 10_000].astype(np.float32))})

    return _files(spark, path).mapInPandas(run, _VECTORS)


def write_npy(vectors: DataFrame, path: str) -> None:
    """A matrix in the order of vec_id, in a file of the driver's machine; rows come a partition at a time, so the driver holds no more than one."""
    n = vectors.count()
    first = vectors.select(F.size("embedding").alias("d")).first()
    if first is None:
        np.save(path, np.zeros((0, 0), np.float32))
        return
    out = np.lib.format.open_memmap(path, "w+", np.float32, (n, first["d"]))
    for i, r in enumerate(vectors.orderBy("vec_id").select("embedding").toLocalIterator()):
        out[i] = r["embedding"]
    out.flush()


def read_large_xvecs(spark: SparkSession, path: str, length: int, element: str = "float32") -> DataFrame:
    """One .fvecs, .ivecs or .bvecs file of any size, whose records hold `length` elements each: it is split among tasks at record boundaries."""
    kind = np.dtype(element)
    record = 4 + length * kind.itemsize

    def parse(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple[int, list[float]]]:
        for raw, number in rows:
            if int(np.frombuffer(raw, "<i4", 1)[0]) != length:
                raise ValueError("records have different lengths")
            yield number, np.frombuffer(raw, kind, length, 4).astype(float).tolist()

    return spark.createDataFrame(spark.sparkContext.binaryRecords(path, record).zipWithIndex().mapPartitions(parse), _VECTORS)


def read_xvecs(spark: SparkSession, path: str, element: str = "float32", most: int | None = None) -> DataFrame:
    """.fvecs (float32), .ivecs (int32) or .bvecs (uint8): records of an int32 length and so many elements."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind = np.dtype(element)
        for f in frames:
            for content in f["content"]:
                if not content:
                    continue
                d = int(np.frombuffer(content, "<i4", 1)[0])
                record = 4 + d * kind.itemsize
                if len(content) % record:
                    raise ValueError("a record is cut off")
                raw = np.frombuffer(content, np.uint8).reshape(-1, record)[:most]
                if (raw[:, :4].copy().view("<i4") != d).any():
                    raise ValueError("records have different lengths")
                rows = raw[:, 4:].copy().view(kind)
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame({"vec_id": np.arange(i, min(i + 10_000, len(rows))), "embedding": list(rows[i : i + 10_000].astype(np.float32))})

    return _files(spark, path).mapInPandas(run, _VECTORS)


def read_counted(spark: SparkSession, path: str, element: str = "float32") -> DataFrame:
    """A file of two int32 (rows, length) and then all elements."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                n, d = (int(x) for x in np.frombuffer(content, "<i4", 2))
                rows = np.frombuffer(content, np.dtype(element), n * d, 8).reshape(n, d)
                yield pd.DataFrame({"vec_id": np.arange(n), "embedding": list(rows.astype(np.float32))})

    return _files(spark, path).mapInPandas(run, _VECTORS)


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """meta, embedding of lines like name<TAB>1|2|3."""
    parts = F.split("value", "\t")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[0].alias("meta"), F.transform(F.split(parts[1], r"\|"), lambda x: x.cast("float")).alias("embedding"))


def read_captions(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with a header: the first of the columns that isn't blank, rows without one left out."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return rows.select(F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns)).alias("text")).where("text is not null")


def read_formulas(spark: SparkSession, path: str) -> DataFrame:
    """One predicate a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("formula")).where("formula <> ''")


def parse_queries(lines: DataFrame) -> DataFrame:
    """lines(value) like `$k:10 $meta:x 1|2|3` or `#base64`: options (map) and the vector as text or bytes."""
    options = F.map_from_entries(F.transform(F.regexp_extract_all("value", F.lit(r"\$(\w+:\S+)"), F.lit(1)), lambda x: F.struct(F.split(x, ":", 2)[0], F.split(x, ":", 2)[1])))
    rest = F.trim(F.regexp_replace("value", r"\$\w+:\S+", ""))
    packed = F.when(rest.startswith("#"), F.unbase64(F.substr(rest, F.lit(2))))
    return lines.select(options.alias("options"), packed.alias("packed"), F.when(~rest.startswith("#"), F.transform(F.split(rest, r"\|"), lambda x: F.expr("float(null)") if x is None else x.try_cast("float"))).alias("q"))


def nested(results: DataFrame) -> DataFrame:
    """query_id, labels, distances: one row a query, in rank order."""
    rows = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("r"))
    return rows.select("query_id", F.transform("r", lambda x: x["vec_id"]).alias("labels"), F.transform("r", lambda x: x["dist"]).alias("distances"))


def flat(rows: DataFrame) -> DataFrame:
    """The reverse of nested(); negative ids are padding and left out."""
    pairs = rows.select("query_id", F.posexplode(F.arrays_zip("labels", "distances")).alias("pos", "r"))
    return pairs.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("r.labels").alias("vec_id"), F.col("r.distances").alias("dist")).where("vec_id >= 0")


def write_results(results: DataFrame, path: str) -> None:
    nested(results).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return flat(spark.read.schema("query_id long, labels array<long>, distances array<double>").json(path))


def nested_by_filter(results: DataFrame) -> DataFrame:
    """filter, queries: an array of query_id, labels, distances and search_time_us for each filter, by query_id. results: filter, query_id, rank, vec_id, dist, search_time_us."""
    rows = results.groupBy("filter", "query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))).alias("r"), F.max("search_time_us").alias("search_time_us"))
    one = F.struct("query_id", F.transform("r", lambda x: x["vec_id"]).alias("labels"), F.transform("r", lambda x: x["dist"]).alias("distances"), "search_time_us")
    return rows.groupBy("filter").agg(F.array_sort(F.collect_list(one)).alias("queries"))


def flat_by_filter(rows: DataFrame) -> DataFrame:
    """The reverse of nested_by_filter(); negative ids are padding and left out."""
    each = rows.select("filter", F.explode("queries").alias("q")).select("filter", "q.*")
    pairs = each.select("filter", "query_id", "search_time_us", F.posexplode(F.arrays_zip("labels", "distances")).alias("pos", "r"))
    return pairs.select("filter", "query_id", (F.col("pos") + 1).alias("rank"), F.col("r.labels").alias("vec_id"), F.col("r.distances").alias("dist"), "search_time_us").where("vec_id >= 0")


def write_labels(lists: DataFrame, path: str) -> None:
    """vec_id, labels, in the order of vec_id within each file."""
    lists.select("vec_id", "labels").sortWithinPartitions("vec_id").write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, labels array<int>").parquet(path)


def read_metadata(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """vec_id, meta (binary): a file of values one after the other, and one of an int32 count and count + 1 uint64 places. Files are paired by their order of name."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content, index in zip(f["content"], f["places"]):
                n = int(np.frombuffer(index, "<i4", 1)[0])
                at = np.frombuffer(index, "<u8", n + 1, 4).astype(np.int64)
                if at[-1] > len(content):
                    raise ValueError("places run over the end")
                for i in range(0, n, 10_000):
                    j = min(n, i + 10_000)
                    yield pd.DataFrame({"vec_id": np.arange(i, j), "meta": [content[at[k] : at[k + 1]] for k in range(i, j)]})

    data, places = (_files(spark, x).withColumn("k", F.row_number().over(Window.orderBy("path"))) for x in (path, index_path))
    both = data.select("k", "content").join(places.select("k", F.col("content").alias("places")), "k")
    return both.select("content", "places").mapInPandas(run, "vec_id long, meta binary")


def number_rows(rows: DataFrame, *order: str, name: str = "vec_id") -> DataFrame:
    """Adds numbers from 0 by order, without one task that sorts all: ranges are numbered apart and put in line."""
    # Kept, as ranges are drawn by sampling and both uses must see the same ones.
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__r", place).join(F.broadcast(before), "__p").withColumn(name, F.col("__r") + F.col("__before")).drop("__p", "__n", "__r", "__before")
