"""Clusters of vectors and searches that visit only some of them.

centroids(cluster_id, centroid) has a size set by the caller's number of clusters, not by the data, and is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexil.functions.arrays import matrix
from vexil.functions.distance import l2_squared
from vexil.functions.pairwise import of_metric
from vexil.lineage import cut
from vexil.operators.knn import Allowed, among, meet, nearest_of_batches, top_k


def centroids(vectors: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """cluster_id, centroid, n: element-wise means, gathered per position with partial sums."""
    parts = vectors.select(cluster, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(cluster, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    rows = means.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ps"), F.max("n").alias("n"))
    return rows.select(F.col(cluster).alias("cluster_id"), F.transform("ps", lambda p: p["m"]).alias("centroid"), "n")


def distances_to(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """vec_id, cluster_id, dist of all pairs."""
    return vectors.select("vec_id", "embedding").crossJoin(F.broadcast(means.select("cluster_id", "centroid"))).select("vec_id", "cluster_id", l2_squared(F.col("embedding"), F.col("centroid")).alias("dist"))


def assign(vectors: DataFrame, means: DataFrame, replicas: int = 1) -> DataFrame:
    """vec_id, cluster_id, dist: the nearest centroids, ties to the smaller id. All centroids go to every task as one row, so nothing is shuffled."""
    one = means.agg(F.collect_list(F.struct("cluster_id", "centroid")).alias("means"))
    near = F.transform("means", lambda m: F.struct(l2_squared(F.col("embedding"), m["centroid"]).alias("dist"), m["cluster_id"].alias("cluster_id")))
    rows = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(one))
    if replicas == 1:
        return rows.select("vec_id", F.array_min(near).alias("b")).select("vec_id", "b.cluster_id", "b.dist")
    return rows.select("vec_id", F.explode(F.slice(F.array_sort(near), 1, replicas)).alias("b")).select("vec_id", "b.cluster_id", "b.dist")


def _nearest(v: np.ndarray, means: np.ndarray, load: np.ndarray | None = None) -> np.ndarray:
    """The place of each vector's nearest mean; load is added to the squared distances."""
    d = (v * v).sum(1)[:, None] + (means * means).sum(1)[None] - 2 * v @ means.T
    return np.argmin(d if load is None else d + load[None], axis=1)


def _round(vectors: DataFrame, means: np.ndarray, load: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the vectors nearest to each mean: a task gives one row for each mean, however many vectors it has."""
    shared = vectors.sparkSession.sparkContext.broadcast((means, load))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        means, load = shared.value
        total, n = np.zeros_like(means), np.zeros(len(means), np.int64)
        for b in batches:
            if len(b):
                v = matrix(b["embedding"])
                at = _nearest(v, means, load)
                np.add.at(total, at, v)
                n += np.bincount(at, minlength=len(means))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(means)), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(n)], ["k", "total", "n"])

    sums = vectors.select("embedding").mapInArrow(run, "k int, total array<double>, n long")
    parts = sums.select("k", "n", F.posexplode("total").alias("pos", "x")).groupBy("k", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = parts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("t"), F.max("n").alias("n")).collect()  # one a mean
    total, n = np.zeros_like(means), np.zeros(len(means), np.int64)
    for r in rows:
        total[r["k"]], n[r["k"]] = [x["x"] for x in r["t"]], r["n"]
    return total, n


def _start(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest hashes."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def _table(spark: SparkSession, means: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(means)], "cluster_id int, centroid array<double>")


def kmeans(vectors: DataFrame, k: int, rounds: int = 10, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Lloyd's method from the k vectors with the smallest hashes. Gives centroids and the assignment to these. Empty clusters keep their centroid."""
    now = _start(vectors, k)
    for _ in range(rounds if len(now) else 0):
        total, n = _round(vectors, now)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now)
        moved = ((new - now) ** 2).sum(1).max()
        now = new
        if moved <= tolerance:
            break
    table = _table(vectors.sparkSession, now)
    return table, assign(vectors, table)


def balanced_kmeans(vectors: DataFrame, k: int, weight: float, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Lloyd's method with prices: a cluster's price, added to all distances to it, rises by weight times the surplus of its share over 1 / k in each round
    (on the scale of the mean distance, by smaller and smaller steps), so that large clusters lose their outer members. With weight 0 it is
    kmeans(). Gives centroids and vec_id, cluster_id, cost."""
    now = _start(vectors, k)
    price, scale = np.zeros(len(now)), 0.0
    for r in range(rounds if len(now) else 0):
        total, n = _round(vectors, now, price)
        means = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now)
        if not scale and weight:
            scale = ((means[:, None] - means[None]) ** 2).sum(2).mean() / len(means)
        now, price = means, price + weight * scale * (n / max(n.sum(), 1) - 1 / len(now)) / np.sqrt(r + 1)
    table = _table(vectors.sparkSession, now)
    prices = vectors.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(price)], "cluster_id int, n double")
    return table, balanced_assign(vectors, table, prices, 1.0)


def balanced_assign(vectors: DataFrame, means: DataFrame, counts: DataFrame, weight: float) -> DataFrame:
    """vec_id, cluster_id, cost: the cluster with the least dist + weight * n; counts: cluster_id, n."""
    loaded = means.join(counts, "cluster_id", "left").agg(F.collect_list(F.struct("cluster_id", "centroid", F.coalesce("n", F.lit(0)).alias("n"))).alias("means"))
    cost = F.transform("means", lambda m: F.struct((l2_squared(F.col("embedding"), m["centroid"]) + weight * m["n"]).alias("cost"), m["cluster_id"].alias("cluster_id")))
    return vectors.select("vec_id", "embedding").crossJoin(F.broadcast(loaded)).select("vec_id", F.array_min(cost).alias("b")).select("vec_id", "b.cluster_id", "b.cost")


def probe(queries: DataFrame, vectors: DataFrame, means: DataFrame, nprobe: int, k: int, allowed: DataFrame | Allowed | None = None) -> DataFrame:
    """Search the nprobe nearest clusters. vectors: vec_id, embedding, cluster_id (a vector may be in several). allowed: query_id, vec_id pairs, or a function of arrays of
    both ids that tells which pairs count."""
    asked = queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("embedding"))
    visits = top_k(distances_to(asked, means), nprobe, ("vec_id",), ("dist", "cluster_id")).select(F.col("vec_id").alias("query_id"), "cluster_id")
    if not isinstance(allowed, DataFrame):
        return among(queries, visits, vectors, k, once=True, allowed=allowed)
    pairs = visits.join(vectors, "cluster_id").join(queries.select("query_id", "q"), "query_id")
    scored = pairs.select("query_id", "vec_id", l2_squared(F.col("embedding"), F.col("q")).alias("dist")).dropDuplicates(["query_id", "vec_id"])
    scored = scored.join(allowed.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return top_k(scored, k).select("query_id", "rank", "vec_id", "dist")


def tenant_probe(queries: DataFrame, vectors: DataFrame, means: DataFrame, access: DataFrame, nprobe: int, k: int) -> DataFrame:
    """Search of the nprobe nearest of those clusters that hold a vector of the query's label. queries: query_id, q, tid; vectors: vec_id, embedding, cluster_id."""
    held = access.join(vectors.select("vec_id", "cluster_id"), "vec_id").select("tid", "cluster_id").distinct()
    near = queries.join(held, "tid").join(F.broadcast(means.select("cluster_id", "centroid")), "cluster_id")
    near = near.select("query_id", "tid", "q", "cluster_id", l2_squared(F.col("centroid"), F.col("q")).alias("dist"))
    visits = top_k(near, nprobe, ("query_id",), ("dist", "cluster_id")).select("query_id", "tid", "q", "cluster_id")
    seen = visits.join(vectors.select("vec_id", "embedding", "cluster_id"), "cluster_id").join(access.select("vec_id", "tid").distinct(), ["vec_id", "tid"], "left_semi")
    scored = seen.select("query_id", "vec_id", l2_squared(F.col("embedding"), F.col("q")).alias("dist")).dropDuplicates(["query_id", "vec_id"])
    return top_k(scored, k).select("query_id", "rank", "vec_id", "dist")


def tuned_probes(queries: DataFrame, vectors: DataFrame, means: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of clusters whose search finds at least that share of the exact neighbours of a (small) set of queries: the rank of each true neighbour's
    cluster among its query's says what any number of probes would find."""
    asked = queries.select(F.col("query_id").alias("vec_id"), F.col("q").alias("embedding"))
    places = top_k(distances_to(asked, means), 1 << 30, ("vec_id",), ("dist", "cluster_id")).select(F.col("vec_id").alias("query_id"), "cluster_id", F.col("rank").alias("place"))
    truth = top_k(meet(queries, vectors.select("vec_id", "embedding", "cluster_id")).select("query_id", "vec_id", "cluster_id", l2_squared(F.col("embedding"), F.col("q")).alias("dist")), k)
    found = truth.select("query_id", "cluster_id").join(places, ["query_id", "cluster_id"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # one a cluster
    total = sum(r["n"] for r in found)
    seen = 0
    for r in found:
        seen += r["n"]
        if seen >= recall * total:
            return r["place"]
    return 1


def node_stats(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """cluster_id, n, variance (mean squared distance to the centroid); vectors: with cluster_id."""
    joined = vectors.join(F.broadcast(means.select("cluster_id", "centroid")), "cluster_id")
    return joined.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(l2_squared(F.col("embedding"), F.col("centroid"))).alias("variance"))


def heads(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """cluster_id, head_id: the member nearest to each centroid. vectors: with cluster_id."""
    joined = vectors.join(F.broadcast(means.select("cluster_id", "centroid")), "cluster_id")
    nearest = F.min(F.struct(l2_squared(F.col("embedding"), F.col("centroid")).alias("d"), "vec_id")).alias("b")
    return joined.groupBy("cluster_id").agg(nearest).select("cluster_id", F.col("b.vec_id").alias("head_id"))


def postings(vectors: DataFrame, head_vectors: DataFrame, replicas: int = 8, limit: int = 118) -> DataFrame:
    """cluster_id, vec_id: every vector under its nearest heads, where a head counts only if no nearer chosen head is closer to it than the vector is;
    lists are cut to the limit's nearest, except that a vector's first list keeps it. head_vectors: cluster_id, centroid."""
    near = top_k(distances_to(vectors, head_vectors), replicas, ("vec_id",), ("dist", "cluster_id"))
    pair = head_vectors.select(F.col("cluster_id").alias("c1"), F.col("centroid").alias("v1")).crossJoin(F.broadcast(head_vectors.select(F.col("cluster_id").alias("c2"), F.col("centroid").alias("v2"))))
    between = pair.select("c1", "c2", l2_squared(F.col("v1"), F.col("v2")).alias("gap"))
    closer = near.alias("a").join(near.alias("b"), (F.col("a.vec_id") == F.col("b.vec_id")) & (F.col("b.rank") < F.col("a.rank")))
    closer = closer.select(F.col("a.vec_id").alias("vec_id"), F.col("a.cluster_id").alias("c1"), F.col("b.cluster_id").alias("c2"), F.col("a.dist").alias("dist"))
    shaded = closer.join(between, ["c1", "c2"]).where("gap < dist").select("vec_id", F.col("c1").alias("cluster_id")).distinct()
    kept = near.join(shaded, ["vec_id", "cluster_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("dist", "vec_id"))
    return kept.withColumn("place", place).where((F.col("place") <= limit) | (F.col("rank") == 1)).select("cluster_id", "vec_id")


def tree(vectors: DataFrame, branch: int = 4, depth: int = 2, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Hierarchical k-means, one pass a level over all nodes at once. Gives nodes(level, node, parent, centroid, n) and paths(vec_id, level, node).

    Nodes of at most `most` vectors aren't split. A child is named parent/number."""
    now = vectors.select("vec_id", "embedding", F.lit("0").alias("node"))
    level_nodes = cut(centroids(now, "node").withColumnRenamed("cluster_id", "node"))
    nodes = level_nodes.select(F.lit(0).alias("level"), "node", F.lit(None).cast("string").alias("parent"), "centroid", "n")
    paths = now.select("vec_id", F.lit(0).alias("level"), "node")
    for level in range(1, depth + 1):
        big = level_nodes.where(F.col("n") > most).select(F.col("node").alias("parent"))
        inside = now.join(F.broadcast(big), now.node == big.parent).drop("node")
        seeds = top_k(inside.withColumn("h", F.xxhash64("vec_id")), branch, ("parent",), ("h", "vec_id")).select("parent", F.concat_ws("/", "parent", "rank").alias("node"), F.transform("embedding", lambda x: x.cast("double")).alias("centroid"))
        seeds = cut(seeds)
        for _ in range(3):
            pairs = inside.join(F.broadcast(seeds), "parent").select("vec_id", "embedding", "parent", "node", l2_squared(F.col("embedding"), F.col("centroid")).alias("dist"))
            best = cut(top_k(pairs, 1, ("vec_id",), ("dist", "node")).select("vec_id", "embedding", "parent", "node"))
            means = cut(centroids(best, "node").withColumnRenamed("cluster_id", "node"))
            seeds = means.withColumn("parent", F.regexp_extract("node", "^(.*)/", 1)).select("parent", "node", "centroid", "n")
        now = best.drop("parent")
        level_nodes = seeds
        nodes = nodes.unionByName(seeds.select(F.lit(level).alias("level"), "node", "parent", "centroid", "n"))
        paths = paths.unionByName(now.select("vec_id", F.lit(level).alias("level"), "node"))
    return nodes, paths


def beam(queries: DataFrame, vectors: DataFrame, nodes: DataFrame, paths: DataFrame, width: int, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Keeps the width nearest nodes of each level and searches the leaves below them. With a width of all nodes it is exact."""
    depth = nodes.agg(F.max("level")).first()[0]
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    now = queries.select("query_id", "q", F.lit("0").alias("node"))
    ends = now.join(F.broadcast(leaves.select("node")), "node", "left_semi")
    for level in range(1, depth + 1):
        children = F.broadcast(nodes.where(F.col("level") == level).select(F.col("node").alias("child"), "parent", "centroid"))
        met = now.join(children, now.node == children.parent).select("query_id", "q", F.col("child").alias("node"), l2_squared(F.col("centroid"), F.col("q")).alias("dist"))
        now = top_k(met, width, ("query_id",), ("dist", "node")).select("query_id", "q", "node")
        ends = ends.unionByName(now.join(F.broadcast(leaves.select("node")), "node", "left_semi").select("query_id", "q", "node"))
    members = paths.join(F.broadcast(leaves.select("node", "level")), ["node", "level"], "left_semi").join(vectors, "vec_id")
    scored = ends.join(members, "node").select("query_id", "vec_id", l2_squared(F.col("embedding"), F.col("q")).alias("dist"))
    if allowed is not None:
        scored = scored.join(allowed.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi")
    return top_k(scored, k).select("query_id", "rank", "vec_id", "dist")


def frontier(queries: DataFrame, sized: DataFrame, boost: float, budget: int) -> DataFrame:
    """query_id, cluster_id: the best clusters by dist - boost * variance whose members before them number less than budget. sized: cluster_id, centroid, n, variance."""
    pairs = queries.crossJoin(F.broadcast(sized)).select("query_id", "cluster_id", "n", (l2_squared(F.col("centroid"), F.col("q")) - boost * F.col("variance")).alias("score"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("score", "cluster_id").rowsBetween(Window.unboundedPreceding, -1))
    return pairs.where(F.lit(True)).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < budget).select("query_id", "cluster_id")


def neighbour_graph(vectors: DataFrame, k: int) -> DataFrame:
    """src, dst, rank, dist: each vector's k nearest others."""
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = top_k(nearest_of_batches(asked, vectors, k, of_metric(l2_squared), allowed=lambda query, vec: query != vec), k)
    return found.select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"), "rank", "dist")


def pruned(graph: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges of a relative neighbourhood graph: an edge goes if a nearer neighbour of its source is closer to its end than the source is."""
    near = graph.join(vectors.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("e")), "dst", "left")
    lists = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "dist", "e"))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                row = pc.list_parent_indices(b["edges"])
                edges = b["edges"].flatten()
                rank, dst, dist, e = (pc.struct_field(edges, x) for x in ("rank", "dst", "dist", "e"))
                own, place, far = row.to_numpy(), rank.to_numpy(), dist.to_numpy()
                there = e.is_valid().to_numpy(zero_copy_only=False)
                v = matrix(e.drop_null())
                ends = np.full((len(e), v.shape[1]), np.nan)  # an end without a vector neither shades nor is shaded
                ends[there] = v
                shaded = np.zeros(len(e), bool)
                for back in range(1, int(np.bincount(own).max(initial=0))):
                    t = np.arange(back, len(e))
                    t = t[(own[t] == own[t - back]) & (place[t - back] < place[t]) & ~shaded[t]]
                    if len(t):
                        shaded[t] = np.cumsum((ends[t] - ends[t - back]) ** 2, axis=1)[:, -1] < far[t]
                kept = pa.array(~shaded)
                yield pa.RecordBatch.from_arrays([x.filter(kept) for x in (b["src"].take(row), dst, rank, dist)], ["src", "dst", "rank", "dist"])

    return lists.mapInArrow(run, "src long, dst long, rank int, dist double")
