"""Approximate nearest neighbours: vantage-point trees per shard.

Vectors are scaled to length one, so that the largest cosine is the smallest Euclidean distance, a metric. Each shard of about
SHARD_BYTES of vectors has a tree: every inner node has a vantage point and the median distance of the shard's vectors below it to
that point; nearer ones go left. A query goes down to its leaf and then visits every branch that the triangle inequality
doesn't rule out, with its bound scaled by `factor`: a branch goes unseen if the query's distance to the median exceeds
factor times its k-th best distance so far. Factor one is exact search; smaller ones prune more.

What a leaf offers is ranked by its cosine in double precision, taken from the vectors as they came, and then by vec_id: products
of matrices only tell which members can't be among the k best. So ties go to the smaller vec_id however many vectors tie.

Blocks of queries are copied to the shards, as they are smaller than these; a shard's tree is sent once for each SPAN blocks, so no task
holds more than a tree and SPAN blocks. Per-shard results are merged by a top-k of all shards.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do rows with a null
vec_id; vectors of differing lengths are only compared with those of their own length; equal scores go to the smaller vec_id; rows
that repeat a vec_id are candidates of their own but never of a query of the same id; other columns aren't read.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexil.llm.shared import cut

SHARD_BYTES, BLOCK, SPAN, LEAF = 16 << 20, 2048, 8, 128
FACTOR = 0.6
_SLACK = 1e-9  # products of matrices differ by less from the cosines that count


class Node(NamedTuple):
    """A leaf has members only."""

    members: np.ndarray
    point: int = -1
    median: float = 0.0
    near: "Node | None" = None
    far: "Node | None" = None


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def build(points: np.ndarray, leaf: int = LEAF, seed: int = 1) -> Node:
    """points: unit vectors. Equal distances don't recurse for ever: a split that leaves one side empty makes a leaf."""
    rng = np.random.default_rng(seed)

    def grow(members: np.ndarray) -> Node:
        if len(members) <= leaf:
            return Node(members)
        # The vantage point that spreads a few others most.
        tries = rng.choice(members, 5, replace=False)
        others = points[rng.choice(members, min(64, len(members)), replace=False)]
        point = int(tries[np.argmax([np.std(_distances(points[t][None], others)) for t in tries])])
        d = _distances(points[point][None], points[members])[0]
        median = float(np.median(d))
        near = d <= median
        if near.all():
            return Node(members)
        return Node(members[:0], point, median, grow(members[near]), grow(members[~near]))

    return grow(np.arange(len(points)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal results."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


class Searcher:
    """k best of one tree for a block of queries. raw: the vectors as they came, of the tree and of the queries."""

    def __init__(self, tree: Node, raw: np.ndarray, ids: np.ndarray, query_raw: np.ndarray, query_ids: np.ndarray, k: int, factor: float, points: np.ndarray | None = None):
        self.tree, self.raw, self.ids, self.query_raw, self.query_ids, self.k, self.factor = tree, raw, ids, query_raw, query_ids, k, factor
        self.points, self.queries = unit(raw) if points is None else points, unit(query_raw)
        self.score = np.full((len(query_ids), k), -np.inf)
        self.at = np.full((len(query_ids), k), -1, np.int64)

    def _leaf(self, members: np.ndarray, who: np.ndarray) -> None:
        for i in range(0, len(members), LEAF):
            self._offer(members[i : i + LEAF], who)

    def _offer(self, members: np.ndarray, who: np.ndarray) -> None:
        near = self.queries[who] @ self.points[members].T
        near[self.query_ids[who][:, None] == self.ids[members][None]] = -np.inf
        least = self.score[who, self.k - 1]
        if len(members) > self.k:
            least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k])
        q, m = np.nonzero((near >= least[:, None] - _SLACK) & (near > -np.inf))
        if not len(q):
            return
        score = cosine(self.query_raw[who[q]], self.raw[members[m]])
        # Only the queries that are offered something are ranked anew.
        rows, back = np.unique(q, return_inverse=True)
        held = who[rows]
        owner = np.concatenate([np.repeat(np.arange(len(rows)), self.k), back])
        every = np.concatenate([self.score[held].ravel(), score])
        name = np.concatenate([self.at[held].ravel(), members[m]])
        order = np.lexsort((np.where(name >= 0, self.ids[name], np.iinfo(np.int64).max), -every, owner))
        starts = np.searchsorted(owner[order], np.arange(len(rows)))
        best = order[starts[:, None] + np.arange(self.k)]
        self.score[held], self.at[held] = every[best], name[best]

    def _visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.near is None:
            self._leaf(node.members, who)
            return
        d = _distances(self.queries[who], self.points[node.point][None])[:, 0]
        inside = d <= node.median
        for first, second, mine in ((node.near, node.far, inside), (node.far, node.near, ~inside)):
            part, gap = who[mine], np.abs(d[mine] - node.median)
            self._visit(first, part)
            # Relaxed triangle inequality: 1e-7 lets rounding never rule out a tie.
            reach = np.sqrt(np.maximum(2 - 2 * self.score[part, self.k - 1], 0))
            self._visit(second, part[gap <= self.factor * reach + 1e-7])

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, point place, score) of the k best of each query."""
        self._visit(self.tree, np.arange(len(self.query_ids)))
        q = np.repeat(np.arange(len(self.query_ids)), self.k)
        at = self.at.ravel()
        found = at >= 0
        return q[found], at[found], self.score.ravel()[found]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding")
    # NaN exceeds every number, so one bound tells non-finite components; null components make forall null.
    sound = F.forall(e, lambda x: (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))


def nearest(vectors: DataFrame, query_every: int = 50, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by query_every, its k nearest other rows."""
    rows = usable(vectors).withColumn("dim", F.size("embedding"))
    is_query = F.col("vec_id") % query_every == 0
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    # Shards and blocks of each length of vectors, from counts of all rows.
    sizes = sizes.select("dim", F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES).alias("shards"), F.greatest(F.ceil(F.col("q") / BLOCK), F.lit(1)).alias("blocks"))
    rows = rows.join(sizes, "dim").withColumn("part", F.xxhash64("vec_id"))
    # Narrow numbers travel as they came; the result is the same, as every use widens them.
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def pack(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        f = f.sort_values("vec_id", kind="stable")
        return f["vec_id"].to_numpy(np.int64), np.stack(f["embedding"].to_numpy()).astype(kind)

    def plant(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        ids, raw = pack(f)
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "spans": [-(-int(f["blocks"].iloc[0]) // SPAN)], "tree": [pickle.dumps((ids, raw, build(unit(raw))))]})

    def block(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "shards": [f["shards"].iloc[0]], "queries": [pickle.dumps(pack(f))]})

    trees = cut(rows.groupBy("dim", F.pmod("part", "shards").alias("shard")).applyInPandas(plant, "dim int, shard long, spans long, tree binary"))
    asked = rows.where(is_query).groupBy("dim", F.pmod(F.floor(F.col("part") / 65536), "blocks").alias("block")).applyInPandas(block, "dim int, block long, shards long, queries binary")
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    trees = trees.withColumn("span", up_to(F.col("spans"))).groupBy("dim", "shard", "span")
    asked = cut(asked).withColumns({"shard": up_to(F.col("shards")), "span": F.floor(F.col("block") / SPAN)}).groupBy("dim", "shard", "span")

    def search(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for tree in trees["tree"]:
            ids, raw, root = pickle.loads(tree)
            points = unit(raw)
            for queries in asked["queries"]:
                query_ids, query_raw = pickle.loads(queries)
                q, at, score = Searcher(root, raw, ids, query_raw, query_ids, k, factor, points).run()
                out.append(pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[at], "score": score}))
        return pd.concat(out)

    found = asked.cogroup(trees).applyInPandas(lambda a, t: search(t, a), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
