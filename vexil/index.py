"""An index over vectors and their grants: train, fill, change, search, keep, load, merge.

The state is tables: vectors (vec_id, embedding, cluster_id, codes), access (vec_id, tid), centroids, and a codebook; cluster_id and codes are
made once, when vectors come in. Changes to single vectors and grants wait in a log on the driver and are applied, last one wins, before
the next search; batches are tables from the start. Searches take a query set as a table, or one vector, which is a set of one.

Rules: ties go to the smaller vec_id; results aren't padded; a grant of a vector that isn't there counts for nothing; a label that no vector has
finds nothing; creating a vec_id again replaces the vector and adds to its grants; deleting one takes its grants with it.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.lineage import cut
from vexil.operators import access as acc
from vexil.operators import cluster, knn, quantiser, selectors, trees
from vexil.plans import predicate

_VECTORS = "vec_id long, embedding array<float>"
_ACCESS = "vec_id long, tid int"
STRATEGIES = ("exact", "clusters", "codes", "overfetch")


class VectorIndex:
    """clusters: how many there are; probes: how many a search visits; parts, codes: of the codebook; factor: how many times k a search by codes reranks."""

    def __init__(self, spark: SparkSession, clusters: int = 16, probes: int = 8, parts: int = 16, codes: int = 256, factor: int = 8, strategy: str = "exact"):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}")
        self.spark, self.clusters, self.probes, self.parts, self.codes, self.factor, self.strategy = spark, clusters, probes, parts, codes, factor, strategy
        self.centroids: DataFrame | None = None
        self.book: quantiser.Book | None = None
        self._vectors = spark.createDataFrame([], f"{_VECTORS}, cluster_id int, codes binary")
        self._access = spark.createDataFrame([], _ACCESS)
        self.filters: dict[str, int] = {}
        self._log: list[tuple] = []

    # Filling and changing

    def train(self, vectors: DataFrame, rounds: int = 10) -> None:
        """Clusters and codebook from a table of vectors, which aren't put into the index."""
        self.centroids = cut(cluster.kmeans(vectors, self.clusters, rounds)[0])
        self.book = quantiser.train(vectors, self.parts, self.codes)

    def batch_create(self, vectors: DataFrame, access: DataFrame | None = None) -> None:
        """vectors: vec_id, embedding; access: vec_id, tid."""
        if self.centroids is None or self.book is None:
            self.train(vectors)
        self._apply()
        rows = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
        placed = cluster.assign(rows, self.centroids).select("vec_id", F.col("cluster_id").cast("int").alias("cluster_id"))
        rows = rows.join(placed, "vec_id").join(quantiser.encode(rows, self.book), "vec_id")
        kept = self._vectors.join(rows.select("vec_id"), "vec_id", "left_anti")
        self._vectors = cut(kept.unionByName(rows))
        if access is not None:
            self._access = cut(acc.distinct_grants(self._access.unionByName(access.select("vec_id", "tid"))))

    def create(self, vec_id: int, embedding: Sequence[float], labels: Sequence[int] = ()) -> None:
        if self.centroids is None:
            raise ValueError("train the index first")
        self._log += [("insert", vec_id, None, [float(x) for x in embedding]), *(("grant", vec_id, t, None) for t in labels)]

    def grant_access(self, vec_id: int, tid: int) -> None:
        self._log.append(("grant", vec_id, tid, None))

    def revoke_access(self, vec_id: int, tid: int) -> None:
        self._log.append(("revoke", vec_id, tid, None))

    def delete_vector(self, vec_id: int) -> None:
        self._log.append(("delete", vec_id, None, None))

    def delete_where(self, chosen: selectors.Selector, metadata: DataFrame) -> None:
        """Deletes the vectors that a selector chooses in a table with vec_id."""
        self._apply()
        gone = cut(chosen.filter(metadata).select("vec_id").distinct())
        self._vectors = cut(self._vectors.join(gone, "vec_id", "left_anti"))
        self._access = cut(self._access.join(gone, "vec_id", "left_anti"))

    def _apply(self) -> None:
        """Brings the waiting log into the tables, in its order."""
        if not self._log:
            return
        # What happened to a vector before it was last deleted is gone with it.
        last_delete = {v: i for i, (op, v, _, _) in enumerate(self._log) if op == "delete"}
        log, self._log = self._log, []
        if last_delete:
            gone = self.spark.createDataFrame([(v,) for v in last_delete], "vec_id long")
            self._vectors = cut(self._vectors.join(F.broadcast(gone), "vec_id", "left_anti"))
            self._access = cut(self._access.join(F.broadcast(gone), "vec_id", "left_anti"))
        rest = [(i, *e) for i, e in enumerate(log) if i > last_delete.get(e[1], -1) and e[0] != "delete"]
        grants = [(v, t, op, i) for i, op, v, t, _ in rest if op != "insert"]
        if grants:
            self._access = cut(acc.apply_log(self._access, self.spark.createDataFrame(grants, f"{_ACCESS}, op string, seq long")))
        new = {v: x for _, op, v, _, x in rest if op == "insert"}
        if new:
            self.batch_create(self.spark.createDataFrame(list(new.items()), _VECTORS))

    @property
    def vectors(self) -> DataFrame:
        self._apply()
        return self._vectors

    @property
    def access(self) -> DataFrame:
        """Grants of the vectors that are there."""
        self._apply()
        return self._access.join(self._vectors.select("vec_id"), "vec_id", "left_semi")

    # Searching

    def _one(self, x: Sequence[float]) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(v) for v in x])], "query_id long, q array<float>")

    @staticmethod
    def _ids(found: DataFrame) -> list[int]:
        return [r["vec_id"] for r in found.orderBy("rank").collect()]

    def _search(self, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
        """The index's strategy over whatever vectors are left."""
        if self.strategy == "clusters":
            return cluster.probe(queries, vectors, self.centroids, self.probes, k)
        if self.strategy == "codes":
            return quantiser.search(queries, vectors, vectors.select("vec_id", "codes"), self.book, k, self.factor)
        return knn.unfiltered(queries, vectors.select("vec_id", "embedding"), k)

    def query(self, x: Sequence[float], k: int, tid: int | None = None) -> list[int]:
        """The ids of the k nearest vectors that the label may see; all, if it is None or negative."""
        if tid is None or tid < 0:
            return self.query_unfiltered(x, k)
        return self._ids(self.batch_query(self._one(x).withColumn("tid", F.lit(tid)), k))

    def query_unfiltered(self, x: Sequence[float], k: int) -> list[int]:
        return self._ids(self._search(self._one(x), self.vectors, k))

    def query_with_complex_predicate(self, x: Sequence[float], k: int, formula: str, notation: str = "prefix") -> list[int]:
        return self._ids(self.predicate_query(self._one(x), k, formula, notation))

    def predicate_query(self, queries: DataFrame, k: int, formula: str, notation: str = "prefix") -> DataFrame:
        node = predicate.parse(formula, notation)
        lists = acc.label_lists(self.vectors, self.access)
        chosen = lists.where(predicate.to_column(node)).select("vec_id")
        return self._search(queries, self.vectors.join(chosen, "vec_id", "left_semi"), k)

    def batch_query(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, dist. queries: query_id, q, tid (null or negative: no filter)."""
        vectors, grants = self.vectors, self.access
        if self.strategy == "overfetch":
            free = queries.where("tid is null or tid < 0").select("query_id", "q")
            found = knn.post_filter(queries.where("tid >= 0"), vectors, grants, k)
            return found.unionByName(knn.unfiltered(free, vectors.select("vec_id", "embedding"), k))
        if self.strategy == "exact":
            return knn.single_label(queries, vectors, grants, k)
        bound = queries.where("tid >= 0")
        allowed = grants.join(bound.select("query_id", "tid"), "tid").select("query_id", "vec_id")
        free = self._search(queries.where("tid is null or tid < 0").select("query_id", "q"), vectors, k)
        if self.strategy == "clusters":
            return cluster.tenant_probe(bound, vectors, self.centroids, grants, self.probes, k).unionByName(free)
        return quantiser.search(bound.select("query_id", "q"), vectors, vectors.select("vec_id", "codes"), self.book, k, self.factor, allowed).unionByName(free)

    def select_query(self, queries: DataFrame, k: int, chosen: selectors.Selector) -> DataFrame:
        """Search among the vectors that a selector (ids, bitmaps, conditions, callbacks) chooses."""
        return self._search(queries, chosen.filter(self.vectors), k)

    def index_filter(self, formula: str, notation: str = "prefix") -> int:
        """A label of its own, from -2 down, for the vectors that meet a predicate now; the same formula gives the same label. query() sees through filter_query()."""
        node = predicate.parse(formula, notation)
        name = predicate.show(node, "prefix")
        if name not in self.filters:
            tid = -2 - len(self.filters)
            lists = acc.label_lists(self.vectors, self.access)
            met = lists.where(predicate.to_column(node)).select("vec_id", F.lit(tid).alias("tid"))
            self._access = cut(self._access.unionByName(met))
            self.filters[name] = tid
        return self.filters[name]

    def filter_query(self, queries: DataFrame, k: int, formula: str, notation: str = "prefix") -> DataFrame:
        """predicate_query() by the label that the predicate was indexed under."""
        tid = self.index_filter(formula, notation)
        return self._search(queries, self.vectors.join(self.access.where(F.col("tid") == tid), "vec_id", "left_semi"), k)

    def iterate(self, x: Sequence[float], batch: int, k: int = 1000):
        """Lists of ids, nearest first, `batch` at a time, from the k nearest; a consumer that stops early fetches no more partitions."""
        found, ids = self._search(self._one(x), self.vectors, k).orderBy("rank"), []
        for r in found.toLocalIterator():
            ids.append(r["vec_id"])
            if len(ids) == batch:
                yield ids
                ids = []
        if ids:
            yield ids

    def reconstruct(self, ids: Sequence[int]) -> DataFrame:
        """vec_id, embedding as the codes of these ids have it."""
        wanted = self.spark.createDataFrame([(int(i),) for i in ids], "vec_id long")
        return quantiser.reconstruct(self.vectors.select("vec_id", "codes").join(F.broadcast(wanted), "vec_id", "left_semi"), self.book)

    # Keeping

    def refine(self, rounds: int = 10) -> None:
        """Clusters, codebook and all that follows from them, anew from the vectors that are there."""
        rows = self.vectors.select("vec_id", "embedding")
        self.train(rows, rounds)
        self._vectors = self.spark.createDataFrame([], self._vectors.schema)
        self.batch_create(rows)

    def merge(self, other: "VectorIndex") -> None:
        """Adds the other's vectors and grants, under this index's clusters and codes; of an id that both have, the other's vector counts."""
        self.batch_create(other.vectors.select("vec_id", "embedding"), other.access)

    def statistics(self) -> dict[str, DataFrame]:
        """sizes: cluster_id, n; labels: tid, n, selectivity; memory: component, bytes."""
        vectors = self.vectors
        sizes = vectors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
        parts = vectors.agg(F.sum(F.size("embedding") * 4).alias("vectors"), F.sum(F.length("codes")).alias("codes"))
        grants = self.access.agg(F.count(F.lit(1)).alias("n")).select((F.col("n") * 12).alias("access"))
        book = 0 if self.book is None else self.book.cells.nbytes
        row = parts.crossJoin(grants).withColumn("codebook", F.lit(book))
        memory = row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("component"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("bytes")) for c in row.columns))))
        return {"sizes": sizes, "labels": acc.selectivity(vectors, self.access), "memory": memory}

    def explain(self, queries: DataFrame, k: int) -> None:
        """Prints the plan of a batch query."""
        self.batch_query(queries, k).explain("formatted")

    def save(self, path: str) -> None:
        """Tables in Parquet under one folder: the vectors by cluster, in the order of their ids, so that a probe of few clusters reads few files; and a manifest."""
        self._apply()
        write_clustered(self._vectors, f"{path}/vectors")
        self._access.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/access")
        if self.centroids is not None:
            self.centroids.write.mode("overwrite").parquet(f"{path}/centroids")
        if self.book is not None:
            rows = [(p, c, cell.tolist()) for p, cells in enumerate(self.book.cells) for c, cell in enumerate(cells)]
            self.spark.createDataFrame(rows, "part int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
        manifest = {"version": 1, "clusters": self.clusters, "probes": self.probes, "parts": self.parts, "codes": self.codes, "factor": self.factor, "strategy": self.strategy, "filters": self.filters}
        manifest |= {"trained": self.centroids is not None, "coded": self.book is not None}
        if self.book is not None and self.book.rotation is not None:
            manifest["rotation"] = self.book.rotation.tolist()
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        index = cls(spark, *(manifest[x] for x in ("clusters", "probes", "parts", "codes", "factor", "strategy")))
        index.filters = manifest["filters"]
        index._vectors = spark.read.schema(f"{_VECTORS}, codes binary, cluster_id int").parquet(f"{path}/vectors").select(*index._vectors.columns)
        index._access = spark.read.schema(_ACCESS).parquet(f"{path}/access")
        if manifest["trained"]:
            index.centroids = spark.read.schema("cluster_id int, centroid array<double>").parquet(f"{path}/centroids")
        if manifest["coded"]:
            rows = spark.read.parquet(f"{path}/codebook").orderBy("part", "code").collect()  # parts * codes rows
            cells = np.array([r["centroid"] for r in rows]).reshape(len({r["part"] for r in rows}), -1, len(rows[0]["centroid"]))
            index.book = quantiser.Book(cells, np.array(manifest["rotation"]) if "rotation" in manifest else None)
        return index


def write_clustered(vectors: DataFrame, path: str) -> None:
    """One folder a cluster, rows by vec_id, packed with zstd; a large cluster has several files."""
    salted = vectors.repartition("cluster_id", F.pmod(F.floor(F.col("vec_id") / 1_000_000), F.lit(64)))
    salted.sortWithinPartitions("cluster_id", "vec_id").write.mode("overwrite").option("compression", "zstd").partitionBy("cluster_id").parquet(path)


def shortlists(access: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """node, tid, vec_ids: the lists that a tree search reads, each at the shallowest node that has at most `most` of the label's vectors below it."""
    at = acc.short_lists(access, paths, most).join(paths, ["vec_id", "level"])
    return at.groupBy("node", "tid").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))


def tree_filters(access: DataFrame, paths: DataFrame, bits: int = 1024) -> DataFrame:
    """node, words: a Bloom filter of the labels below each node."""
    return trees.bloom(acc.distinct_grants(access).join(paths, "vec_id").select("node", "tid").distinct(), "node", bits=bits)
