"""Trees of clusters: paths, statistics, occupancy by prefix, best-first search with pruning, Bloom filters of labels, and KD-trees.

nodes(level, node, parent, centroid, n) and paths(vec_id, level, node) are as cluster.tree makes them: a node's name is its parent's, a
slash and a number, so the names of a vector's nodes are the prefixes of its leaf's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.functions.arrays import matrix
from vexil.functions.distance import l2_squared
from vexil.functions.pairwise import of_metric
from vexil.operators import knn
from vexil.operators.knn import among, top_k


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def leaf_of(paths: DataFrame) -> DataFrame:
    """vec_id, leaf: the deepest node of each vector."""
    return paths.groupBy("vec_id").agg(F.max_by("node", "level").alias("leaf"))


def prefixes(path: Column | str) -> Column:
    """The names of a node and of all above it, from the root on."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def occupancy(members: DataFrame) -> DataFrame:
    """node, level, n: how many of the members (vec_id, leaf) lie below each node; a search over a qualified set visits these nodes alone."""
    return members.select(F.posexplode(prefixes("leaf")).alias("level", "node")).groupBy("node", "level").agg(F.count(F.lit(1)).alias("n"))


def statistics(nodes: DataFrame) -> DataFrame:
    """One row: nodes, leaves, mean and greatest depth of the leaves, and the mean and the greatest number of their members."""
    ends = leaves(nodes).agg(F.count(F.lit(1)).alias("n_leaves"), F.avg("level").alias("mean_depth"), F.max("level").alias("depth"), F.avg("n").alias("mean_size"), F.max("n").alias("largest"))
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes")).crossJoin(ends)


def _nodes_row(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("parent").agg(F.collect_list(F.struct("node", "centroid")).alias("children"))


def insert(vectors: DataFrame, nodes: DataFrame, capacity: int | None = None) -> DataFrame:
    """vec_id, leaf: each vector goes from the root to the nearest child, level by level (ties: the smaller name). The tree's size is set by its
    parameters, so its nodes are sent to every task. capacity: raises if a leaf would hold more, those that are in it (n) included."""
    depth = nodes.agg(F.max("level")).first()[0] or 0
    now = vectors.select("vec_id", "embedding", F.lit("0").alias("leaf"))
    children = F.broadcast(_nodes_row(nodes.where("parent is not null")))
    for _ in range(depth):
        met = now.join(children, now["leaf"] == children["parent"], "left")
        near = F.array_min(F.transform("children", lambda c: F.struct(l2_squared(F.col("embedding"), c["centroid"]).alias("dist"), c["node"].alias("node"))))
        now = met.select("vec_id", "embedding", F.coalesce(near["node"], F.col("leaf")).alias("leaf"))
    out = now.select("vec_id", "leaf")
    if capacity is not None:
        sizes = out.groupBy("leaf").agg(F.count(F.lit(1)).alias("more")).join(nodes.select(F.col("node").alias("leaf"), "n"), "leaf")
        full = sizes.where(F.col("n") + F.col("more") > capacity).limit(1).collect()
        if full:
            raise ValueError(f"leaf {full[0]['leaf']} would hold more than {capacity} vectors")
    return out


def best_first(queries: DataFrame, vectors: DataFrame, sized: DataFrame, budget: int, k: int, boost: float = 0.0, prune: float = 2.0) -> DataFrame:
    """Leaves by dist - boost * variance, as many as hold `budget` vectors, less those whose own distance exceeds prune times the smallest one of the visited; then
    exact search in them. vectors: vec_id, embedding, cluster_id; sized: cluster_id, centroid, n, variance."""
    from vexil.operators.cluster import frontier

    seen = frontier(queries, sized, boost, budget)
    near = seen.join(F.broadcast(sized.select("cluster_id", "centroid")), "cluster_id").join(queries, "query_id")
    near = near.select("query_id", "cluster_id", l2_squared(F.col("centroid"), F.col("q")).alias("d"))
    least = near.groupBy("query_id").agg(F.min("d").alias("least"))
    visits = near.join(least, "query_id").where(F.col("d") <= prune * F.col("least")).select("query_id", "cluster_id")
    return among(queries, visits, vectors, k)


# Bloom filters of labels, as arrays of 64-bit words: fixed in size, or-ed up the tree.


def _bits(tid: str | Column, bits: int, hashes: int) -> Column:
    """The places that a label sets."""
    tid = F.col(tid) if isinstance(tid, str) else tid
    return F.array(*(F.pmod(F.xxhash64(F.lit(i), tid.cast("long")), F.lit(bits).cast("long")) for i in range(hashes)))


def bloom(rows: DataFrame, by: str, tid: str = "tid", bits: int = 1024, hashes: int = 4) -> DataFrame:
    """by, words: a Bloom filter of each group's labels; partial results are or-ed, a row for each word."""
    places = rows.select(by, F.explode(_bits(tid, bits, hashes)).alias("p"))
    words = places.select(by, F.floor(F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("v")).groupBy(by, "w").agg(F.bit_or("v").alias("v"))
    held = words.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return held.select(by, F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def may_hold(words: str | Column, tid: str | Column, hashes: int = 4) -> Column:
    """False only if the label isn't in the filter."""
    words = F.col(words) if isinstance(words, str) else words
    size = F.size(words) * 64
    tid = F.col(tid) if isinstance(tid, str) else tid
    test = [F.getbit(F.get(words, F.floor(F.pmod(F.xxhash64(F.lit(i), tid.cast("long")), size.cast("long")) / 64).cast("int")), F.pmod(F.xxhash64(F.lit(i), tid.cast("long")), size.cast("long")).cast("int") % 64) == 1 for i in range(hashes)]
    out = test[0]
    for t in test[1:]:
        out = out & t
    return out


def combined(a: str | Column, b: str | Column, how: str) -> Column:
    """union, intersection or difference (xor) of two filters of one size, word by word."""
    f = {"union": lambda x, y: x.bitwiseOR(y), "intersection": lambda x, y: x.bitwiseAND(y), "xor": lambda x, y: x.bitwiseXOR(y)}[how]
    return F.zip_with(a, b, f)


# KD-trees


def kd_tree(vectors: DataFrame, depth: int, sample: int = 20_000) -> DataFrame:
    """node, dim, cut: nodes named by the path of 0 (up to the cut) and 1, each cut at the middle of the dimension that varies most there. Built level
    by level from about `sample` vectors, with approximate medians."""
    n = vectors.count()
    rows = vectors.select("vec_id", "embedding")
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    spark, cuts = vectors.sparkSession, []
    now = rows.withColumn("node", F.lit(""))
    for _ in range(depth):
        cells = now.select("node", F.posexplode("embedding").alias("dim", "x"))
        spread = cells.groupBy("node", "dim").agg(F.var_pop("x").alias("v"), F.percentile_approx("x", 0.5, 1000).alias("cut"), F.max("x").alias("most"))
        widest = spread.where("cut < most").groupBy("node").agg(F.max(F.struct("v", F.negate("dim").alias("d"), "cut")).alias("b"))
        level = [(r["node"], -r["d"], float(r["cut"])) for r in widest.select("node", "b.d", "b.cut").collect()]  # 2**depth rows
        if not level:
            break
        cuts += level
        now = _descend(now, spark.createDataFrame(level, _KD))
    return spark.createDataFrame(cuts, _KD)


_KD = "node string, dim int, cut double"


def _descend(rows: DataFrame, level: DataFrame) -> DataFrame:
    side = F.when(F.get("embedding", F.col("dim")) <= F.col("cut"), F.lit("0")).otherwise(F.lit("1"))
    return rows.join(F.broadcast(level), "node", "left").withColumn("node", F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.concat("node", side))).drop("dim", "cut")


def kd_leaf(vectors: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds node, the leaf of each vector."""
    depth = cuts.agg(F.max(F.length("node"))).first()[0]
    out = vectors.withColumn("node", F.lit(""))
    for level in range(0 if depth is None else depth + 1):
        out = _descend(out, cuts.where(F.length("node") == level))
    return out


def kd_probe(queries: DataFrame, vectors: DataFrame, cuts: DataFrame, k: int, factor: float = 1.0) -> DataFrame:
    """Search by a KD-tree: a query's own leaf gives its k-th distance; every leaf whose cuts lie nearer than factor times that is searched. Factor 1 is exact."""
    placed = kd_leaf(vectors.select("vec_id", "embedding"), cuts)
    own = kd_leaf(queries.select(F.col("query_id"), F.col("q"), F.col("q").alias("embedding")), cuts).drop("embedding")
    first = among(queries, own.select("query_id", "node"), placed, k, "node")
    bound = first.groupBy("query_id").agg(F.max("dist").alias("far"), F.count(F.lit(1)).alias("n"))
    bound = queries.select("query_id", "q").join(bound, "query_id", "left").select("query_id", "q", F.when(F.col("n") >= k, F.col("far") * factor).otherwise(float("inf")).alias("reach"))
    # Down the tree: the near side always, the far one if the cut's squared distance is within reach.
    depth = cuts.agg(F.max(F.length("node"))).first()[0]
    now = bound.withColumn("node", F.lit(""))
    for level in range(0 if depth is None else depth + 1):
        met = now.join(F.broadcast(cuts.where(F.length("node") == level)), "node", "left")
        x = F.get(F.col("q"), F.col("dim")).cast("double")
        near = F.when(x <= F.col("cut"), "0").otherwise("1")
        far = F.when(x <= F.col("cut"), "1").otherwise("0")
        both = F.when((x - F.col("cut")) * (x - F.col("cut")) <= F.col("reach"), F.array(near, far)).otherwise(F.array(near))
        sides = F.when(F.col("dim").isNull(), F.array(F.lit(""))).otherwise(both)
        now = met.select("query_id", "q", "reach", F.explode(F.transform(sides, lambda s: F.concat("node", s))).alias("node"))
    return among(queries, now.select("query_id", "node"), placed, k, "node")


# Neighbours inside random parts


def partition_graph(vectors: DataFrame, k: int, trees: int = 8, leaf: int = 256, seed: int = 1) -> DataFrame:
    """src, dst, rank, dist: each vector's k nearest among those that share a leaf with it in any of several random-projection trees. No pair of
    vectors in different leaves is made; a vector meets at most trees * leaf others, about."""
    n = vectors.count()
    depth = max(0, (max(n - 1, 0) // leaf).bit_length())
    spark = vectors.sparkSession
    first = vectors.select(F.size("embedding").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], "src long, dst long, rank int, dist double")
    lines = np.random.default_rng(seed).normal(size=(trees, depth, first["d"]))
    rows = vectors.select("vec_id", "embedding").where("embedding is not null")
    cuts = []  # of each level, each tree's and part's
    for level in range(depth):
        middle = np.full((trees, 1 << level), np.inf)
        sides = rows.mapInArrow(_sides(spark, lines, cuts, level), "tree int, part long, x double")
        for r in sides.groupBy("tree", "part").agg(F.percentile_approx("x", 0.5, 1000).alias("cut")).collect():  # trees * 2**level rows, in all about trees * n / leaf
            middle[r["tree"], r["part"]] = r["cut"]
        cuts.append(middle)
    leaves = rows.mapInArrow(_sides(spark, lines, cuts, None), "tree int, part long, vec_id long, embedding " + rows.schema["embedding"].dataType.simpleString())

    def near(members: pa.Table) -> pa.Table:
        ids, v = members["vec_id"].to_numpy(), matrix(members["embedding"])
        step, parts = max(1, knn._CELLS // len(v)), []
        for at in range(0, len(v), step):
            i, j, dist = knn._nearest(v[at : at + step], v, ids, k, of_metric(l2_squared), free=ids[at : at + step, None] != ids[None])
            parts.append(pa.table([ids[at : at + step][i], ids[j], dist], ["src", "dst", "dist"]))
        return pa.concat_tables(parts)

    found = leaves.groupBy("tree", "part").applyInArrow(near, "src long, dst long, dist double").dropDuplicates(["src", "dst"])
    return top_k(found, k, ("src",), ("dist", "dst")).select("src", "dst", "rank", "dist")


def _sides(spark: SparkSession, lines: np.ndarray, cuts: list[np.ndarray], level: int | None):
    """Of each tree: every vector's part under the cuts and its place on the line of a level; or its part, id and vector, if there is no further level."""
    shared = spark.sparkContext.broadcast((lines, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, cuts = shared.value
        for b in batches:
            if not len(b):
                continue
            v = matrix(b["embedding"])
            for tree in range(len(lines)):
                part = np.zeros(len(v), np.int64)
                for line, middle in zip(lines[tree], cuts):
                    part = part * 2 + (v @ line > middle[tree][part])
                own = [pa.array(np.full(len(v), tree, np.int32)), pa.array(part)]
                if level is None:
                    yield pa.RecordBatch.from_arrays([*own, b["vec_id"], b["embedding"]], ["tree", "part", "vec_id", "embedding"])
                else:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(v @ lines[tree, level])], ["tree", "part", "x"])

    return run
