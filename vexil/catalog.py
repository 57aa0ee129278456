"""All queries of the vector engine, and the SQL that they are held against.

The embeddings are the vectors, every twentieth of them (vec_id divisible by 20) a query against all; grants are derived: a vector's label,
10 + vec_id % 7 and 20 + vec_id % 3. Recorded runs are a table of recall and rate derived from the ids. The codebook of the quantised
searches with SQL has the slices of the labels' means; trained ones are in catalog_index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexil.functions import distance
from vexil.operators import access as acc
from vexil.operators import cluster, evaluate, knn, quantiser, workload
from vexil.plans import predicate
from vexil.sources import formats

Query = Callable[[SparkSession, str], DataFrame]
K = 10
#: Predicates in prefix notation, by the names of their queries.
FORMULAS = {"and": "AND 0 10", "or": "OR 1 11", "not": "NOT 3", "and_not": "AND 10 NOT 21", "or3": "OR 2 OR 12 22", "mixed": "OR 0 AND 10 NOT 21", "empty": "AND 0 999"}
NODES = {name: predicate.parse(f) for name, f in FORMULAS.items()}

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The relations over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
        self.vectors = self.rows.select("vec_id", "embedding")
        parts = (F.col("label"), (10 + F.col("vec_id") % 7).cast("int"), (20 + F.col("vec_id") % 3).cast("int"))
        self.grants = self.rows.select("vec_id", F.explode(F.array(*parts)).alias("tid"))
        self.clustered = self.rows.select("vec_id", "embedding", F.col("label").alias("cluster_id"))
        asked = self.rows.where("vec_id % 20 = 0")
        self.queries = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        self.labelled = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("tid"))
        self.runs = self.rows.select(F.col("vec_id").alias("run_id"), (F.col("vec_id") % 40 / 40.0).alias("recall"), (1000.0 / (1 + F.col("vec_id") * 37 % 101)).alias("qps"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def lists(self) -> DataFrame:
        return acc.label_lists(self.vectors, self.grants)

    def means(self) -> DataFrame:
        return cluster.centroids(self.clustered)

    def probed(self, nprobe: int = 9) -> DataFrame:
        return cluster.probe(self.queries, self.clustered, self.means(), nprobe, K)


def _dist(a: str, b: str, term: str = "({x} - {y}) * ({x} - {y})") -> str:
    body = term.format(x=f"CAST({a}[i] AS DOUBLE)", y=f"CAST({b}[i] AS DOUBLE)")
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {body}))"


WITH = f"""WITH access AS (SELECT vec_id, label AS tid FROM embeddings UNION ALL SELECT vec_id, CAST(10 + vec_id % 7 AS INT) FROM embeddings UNION ALL SELECT vec_id, CAST(20 + vec_id % 3 AS INT) FROM embeddings),
lists AS (SELECT vec_id, list_sort(list_distinct(list(tid))) AS labels FROM access GROUP BY vec_id),
queries AS (SELECT vec_id AS query_id, embedding AS q, label AS tid FROM embeddings WHERE vec_id % 20 = 0),
pairs AS (SELECT query_id, vec_id, {_dist("embedding", "q")} AS dist FROM queries, embeddings),
truth AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs QUALIFY rank <= {K}),
spread AS (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
means AS (SELECT label AS cluster_id, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM spread GROUP BY ALL) GROUP BY label),
runs AS (SELECT vec_id AS run_id, vec_id % 40 / 40.0 AS recall, 1000.0 / (1 + vec_id * 37 % 101) AS qps FROM embeddings)
"""


def _ranked(source: str, k: int = K, order: str = "dist, vec_id") -> str:
    return f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INT) AS rank, vec_id, round(dist, 6) AS dist FROM ({source}) QUALIFY rank <= {k}"


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = WITH + sql
        return f

    return put


def _near(df: DataFrame) -> DataFrame:
    return df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("dist", 6).alias("dist"))


# Search


@register("knn_single_label", _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN queries USING (query_id) JOIN access USING (vec_id, tid)"))
def _(t: Tables) -> DataFrame:
    return _near(knn.single_label(t.labelled, t.vectors, t.grants, K))


@register("knn_unfiltered", _ranked("SELECT * FROM pairs"))
def _(t: Tables) -> DataFrame:
    return _near(knn.unfiltered(t.queries, t.vectors, K))


@register("knn_blocked", _ranked("SELECT * FROM pairs"))
def _(t: Tables) -> DataFrame:
    return _near(knn.blocked(t.queries, t.vectors, K))


@register("knn_range", "SELECT query_id, vec_id, round(dist, 6) AS dist FROM pairs WHERE dist < 1.5")
def _(t: Tables) -> DataFrame:
    return knn.within(t.queries, t.vectors, 1.5).withColumn("dist", F.round("dist", 6))


@register("knn_paged", f"SELECT * FROM ({_ranked('SELECT * FROM pairs', 30)}) WHERE rank BETWEEN 11 AND 20")
def _(t: Tables) -> DataFrame:
    return _near(knn.page(knn.unfiltered(t.queries, t.vectors, 30), 1, 10))


@register("knn_within_ratio", f"SELECT * FROM ({_ranked('SELECT * FROM pairs WHERE dist > 0', 30)}) r WHERE dist <= 1.2 * (SELECT min(round(dist, 6)) FROM pairs p WHERE p.query_id = r.query_id AND dist > 0)")
def _(t: Tables) -> DataFrame:
    others = _near(knn.unfiltered(t.queries, t.vectors, 30, apart=True))
    return _near(knn.within_ratio(others, 1.2))


def _predicate_query(name: str, node: predicate.Node) -> None:
    source = f"SELECT query_id, vec_id, dist FROM pairs JOIN lists USING (vec_id) WHERE {predicate.to_sql(node)}"

    @register(f"knn_pred_{name}", _ranked(source))
    def _(t: Tables) -> DataFrame:
        return _near(knn.under_predicate(t.queries, t.vectors.join(t.lists(), "vec_id"), predicate.to_column(node), K))


for _name, _node in NODES.items():
    _predicate_query(_name, _node)

# A formula by hand, so that a fault in the compiler can't hide in both.
ORACLES["knn_pred_mixed"] = WITH + _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN embeddings e USING (vec_id) WHERE e.label = 0 OR (vec_id % 7 = 0 AND vec_id % 3 <> 1)")
ORACLES["knn_pred_and_not"] = WITH + _ranked("SELECT query_id, vec_id, dist FROM pairs WHERE vec_id % 7 = 0 AND vec_id % 3 <> 1")
ORACLES["knn_pred_not"] = WITH + _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN embeddings e USING (vec_id) WHERE e.label <> 3")


@register("knn_pred_not_unlabelled", _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN embeddings e USING (vec_id) WHERE vec_id % 50 = 0 OR e.label <> 3"))
def _(t: Tables) -> DataFrame:
    lists = acc.label_lists(t.vectors, t.grants.where("vec_id % 50 <> 0"))
    return _near(knn.under_predicate(t.queries, t.vectors.join(lists, "vec_id"), predicate.to_column(NODES["not"]), K))


@register("knn_per_query_filter", _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN lists USING (vec_id) WHERE CASE WHEN query_id % 3 = 0 THEN list_contains(labels, 1) OR list_contains(labels, 11) WHEN query_id % 3 = 1 THEN list_contains(labels, 0) AND list_contains(labels, 10) ELSE TRUE END"))
def _(t: Tables) -> DataFrame:
    which = F.when(F.col("query_id") % 3 == 0, "or").when(F.col("query_id") % 3 == 1, "and")
    chosen = {x: NODES[x] for x in ("or", "and")}
    return _near(knn.per_query_filter(t.queries.withColumn("filter_id", which), t.vectors, predicate.qualified(t.lists(), chosen), K))


@register("filter_precedence", "SELECT query_id, CASE WHEN query_id // 20 % 4 = 0 THEN 'NOT 3' WHEN query_id // 20 % 4 = 1 THEN 'OR 1 11' WHEN query_id // 20 % 4 = 2 THEN CAST(tid AS VARCHAR) END AS formula FROM queries")
def _(t: Tables) -> DataFrame:
    m = F.expr("query_id div 20 % 4")
    own, default = F.when(m == 0, "NOT 3").when(m == 1, " "), F.when(m <= 1, "OR 1 11")
    return t.labelled.select("query_id", predicate.resolve(own, default, F.when(m == 2, F.col("tid")).otherwise(-1)).alias("formula"))


_METRICS = {
    "cosine": ("1 - {dot} / (sqrt({aa}) * sqrt({bb}))", "cosine"), "ip": ("1 - {dot}", "ip"),
    "l1": (_dist("embedding", "q", "abs({x} - {y})"), "l1"), "linf": (f"list_max(list_transform(range(1, len(q) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE))))", "linf"),
    "canberra": (_dist("embedding", "q", "coalesce(abs({x} - {y}) / nullif(abs({x}) + abs({y}), 0), 0)"), "canberra"),
    "bray_curtis": (f"{_dist('embedding', 'q', 'abs({x} - {y})')} / {_dist('embedding', 'q', 'abs({x} + {y})')}", "bray_curtis"),
}
_PRODUCTS = {"dot": _dist("embedding", "q", "{x} * {y}"), "aa": _dist("embedding", "embedding", "{x} * {y}"), "bb": _dist("q", "q", "{x} * {y}")}


def _metric_query(name: str, expression: str, metric: str) -> None:
    body = expression.format(**_PRODUCTS) if "{dot}" in expression else expression

    @register(f"knn_{name}", f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS INT) AS rank, vec_id, dist FROM (SELECT query_id, vec_id, round({body}, 9) + CAST(0 AS DOUBLE) AS dist FROM queries, embeddings) QUALIFY rank <= {K}")
    def _(t: Tables) -> DataFrame:
        found = knn.unfiltered(t.queries, t.vectors, K, distance.METRICS[metric], digits=9)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "dist")


for _name, (_sql, _metric) in _METRICS.items():
    _metric_query(_name, _sql, _metric)


@register("knn_multi_index", _ranked(f"SELECT query_id, vec_id, 0.7 * {_dist('embedding[1:32]', 'q[1:32]')} + 0.3 * {_dist('embedding[33:64]', 'q[33:64]')} AS dist FROM queries, embeddings"))
def _(t: Tables) -> DataFrame:
    halves = [F.slice("embedding", 1, 32).alias("e1"), F.slice("embedding", 33, 32).alias("e2")]
    vectors = t.vectors.select("vec_id", *halves)
    asked = vectors.where("vec_id % 20 = 0").toDF("query_id", "q1", "q2")
    return _near(knn.weighted(asked, vectors, [("e1", "q1", 0.7), ("e2", "q2", 0.3)], K))


@register("postfilter_overfetch", _ranked("""SELECT query_id, vec_id, dist FROM (
  SELECT p.query_id, p.vec_id, p.dist, q.tid, row_number() OVER (PARTITION BY p.query_id ORDER BY dist, vec_id) AS place FROM pairs p JOIN queries q USING (query_id)) f
JOIN (SELECT tid, count(DISTINCT vec_id) / (SELECT count(*) FROM embeddings) AS share FROM access GROUP BY tid) s USING (tid) JOIN (SELECT DISTINCT vec_id, tid FROM access) a USING (vec_id, tid)
WHERE place <= least((SELECT count(*) FROM embeddings), ceil(10 * least(greatest(10 / share, 10), 200)))"""))
def _(t: Tables) -> DataFrame:
    return _near(knn.post_filter(t.labelled, t.vectors, t.grants, K))


@register("knn_routed", _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN queries USING (query_id) JOIN access USING (vec_id, tid)"))
def _(t: Tables) -> DataFrame:
    return _near(knn.route(t.labelled, t.vectors, t.grants, K))


@register("knn_live", _ranked("SELECT query_id, vec_id, dist FROM pairs WHERE vec_id % 9 <> 0"))
def _(t: Tables) -> DataFrame:
    versions = t.vectors.withColumn("version", F.lit(1)).unionByName(t.vectors.where("vec_id % 9 = 1").withColumn("version", F.lit(2)))
    dead = t.vectors.where("vec_id % 9 = 0").select("vec_id", F.lit(3).alias("version"))
    return _near(knn.unfiltered(t.queries, acc.latest(versions, dead).select("vec_id", "embedding"), K))


@register("knn_sharded", f"SELECT shard, query_id, CAST(row_number() OVER (PARTITION BY shard, query_id ORDER BY dist, vec_id) AS INT) AS rank, vec_id, round(dist, 6) AS dist FROM (SELECT vec_id % 4 AS shard, * FROM pairs) QUALIFY rank <= {K}")
def _(t: Tables) -> DataFrame:
    return knn.sharded(t.queries, t.vectors.withColumn("shard", F.col("vec_id") % 4), K).select("shard", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("dist", 6).alias("dist"))


# Access


@register("label_selectivity", "SELECT tid, count(DISTINCT vec_id) AS n, count(DISTINCT vec_id) / (SELECT count(*) FROM embeddings) AS selectivity FROM access GROUP BY tid")
def _(t: Tables) -> DataFrame:
    return acc.selectivity(t.vectors, t.grants)


@register("inverted_list_sizes", "SELECT l_suppkey AS tid, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
def _(t: Tables) -> DataFrame:
    return acc.inverted_sizes(t.table("lineitem").select(F.col("l_partkey").alias("vec_id"), F.col("l_suppkey").alias("tid")))


@register("label_lists", "SELECT vec_id, array_to_string(labels, ',') AS labels FROM lists")
def _(t: Tables) -> DataFrame:
    return t.lists().select("vec_id", F.array_join("labels", ",").alias("labels"))


@register("label_bitmaps", "SELECT tid, count(DISTINCT vec_id) AS n FROM access GROUP BY tid")
def _(t: Tables) -> DataFrame:
    return acc.bitmaps(t.grants).groupBy("tid").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


@register("access_dedupe", "SELECT DISTINCT l_partkey AS vec_id, l_suppkey AS tid FROM lineitem")
def _(t: Tables) -> DataFrame:
    return acc.distinct_grants(t.table("lineitem").select(F.col("l_partkey").alias("vec_id"), F.col("l_suppkey").alias("tid")))


@register("access_after_revoke", "SELECT DISTINCT vec_id, tid FROM access WHERE (vec_id + tid) % 11 <> 0")
def _(t: Tables) -> DataFrame:
    return acc.revoke(t.grants.unionByName(t.grants.where("vec_id % 5 = 0")), t.grants.where("(vec_id + tid) % 11 = 0"))


@register("access_log", "SELECT DISTINCT vec_id, tid FROM access WHERE vec_id % 4 <> 0 UNION SELECT vec_id, 99 FROM embeddings WHERE vec_id % 6 = 0")
def _(t: Tables) -> DataFrame:
    log = t.grants.where("vec_id % 4 = 0").select("vec_id", "tid", F.explode(F.array(F.struct(F.lit("grant").alias("op"), F.lit(1).alias("seq")), F.struct(F.lit("revoke").alias("op"), F.lit(2).alias("seq")))).alias("e"))
    new = t.vectors.where("vec_id % 6 = 0").select("vec_id", F.lit(99).alias("tid"), F.lit("grant").alias("op"), F.lit(3).alias("seq"))
    return acc.apply_log(t.grants, log.select("vec_id", "tid", "e.*").unionByName(new))


@register("dense_labels", "SELECT tid, CAST(dense_rank() OVER (ORDER BY tid) - 1 AS INT) AS dense_tid FROM (SELECT DISTINCT tid FROM access)")
def _(t: Tables) -> DataFrame:
    return acc.dense_ids(t.grants)


@register("pred_selectivity", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS filter_id, count(*) FILTER (WHERE {predicate.to_sql(x)}) AS n_qualified, count(*) FILTER (WHERE {predicate.to_sql(x)}) / count(*) AS selectivity FROM lists" for n, x in NODES.items()) + ")")
def _(t: Tables) -> DataFrame:
    return predicate.selectivity(t.lists(), NODES)


@register("pred_qualified", " UNION ALL ".join(f"SELECT vec_id, '{n}' AS filter_id FROM lists WHERE {predicate.to_sql(x)}" for n, x in NODES.items()))
def _(t: Tables) -> DataFrame:
    return predicate.qualified(t.lists(), NODES)


@register("access_orphans", "SELECT DISTINCT l_partkey AS vec_id, l_suppkey AS tid FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 0)")
def _(t: Tables) -> DataFrame:
    pairs = t.table("lineitem").select(F.col("l_partkey").alias("vec_id"), F.col("l_suppkey").alias("tid"))
    return acc.unknown_grants(t.table("part").where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("vec_id")), pairs).distinct()


# Clusters and quantisation


@register("centroid_by_label", "SELECT cluster_id, CAST(i AS INT) AS pos, round(centroid[i + 1], 6) AS m FROM means, range(0, 64) r(i)")
def _(t: Tables) -> DataFrame:
    return t.means().select("cluster_id", F.posexplode("centroid").alias("pos", "m")).withColumn("m", F.round("m", 6))


_NEAREST = f"SELECT vec_id, cluster_id, {_dist('embedding', 'centroid')} AS d FROM embeddings, means"


@register("nearest_centroid_assign", f"SELECT vec_id, arg_min(cluster_id, (round(d, 9), cluster_id)) AS cluster_id, round(min(d), 6) AS dist FROM ({_NEAREST}) GROUP BY vec_id")
def _(t: Tables) -> DataFrame:
    return cluster.assign(t.vectors, t.means()).withColumn("dist", F.round("dist", 6))


@register("ivf_probe_knn", _ranked(f"SELECT query_id, e.vec_id, {_dist('e.embedding', 'q')} AS dist FROM queries JOIN (SELECT vec_id AS query_id, cluster_id FROM ({_NEAREST}) WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), cluster_id) <= 9) USING (query_id) JOIN embeddings e ON e.label = cluster_id"))
def _(t: Tables) -> DataFrame:
    return _near(t.probed())


@register("ivf_all_clusters", _ranked("SELECT * FROM pairs"))
def _(t: Tables) -> DataFrame:
    return _near(t.probed(10))


@register("node_variance", f"SELECT cluster_id, count(*) AS n, round(avg({_dist('embedding', 'centroid')}), 6) AS variance FROM embeddings JOIN means ON label = cluster_id GROUP BY cluster_id")
def _(t: Tables) -> DataFrame:
    return cluster.node_stats(t.clustered, t.means()).withColumn("variance", F.round("variance", 6))


@register("cluster_heads", f"SELECT cluster_id, arg_min(vec_id, (round({_dist('embedding', 'centroid')}, 9), vec_id)) AS head_id FROM embeddings JOIN means ON label = cluster_id GROUP BY cluster_id")
def _(t: Tables) -> DataFrame:
    return cluster.heads(t.clustered, t.means())


_CODES = f"""codes AS (SELECT vec_id, p, arg_min(c, (round(d, 9), c)) AS code FROM (SELECT v.vec_id, p, b.cluster_id AS c, {_dist('v.embedding[4 * p + 1 : 4 * p + 4]', 'b.centroid[4 * p + 1 : 4 * p + 4]')} AS d
  FROM embeddings v, means b, range(0, 16) r(p)) GROUP BY ALL)"""
_ADC = f"""{_CODES}, cells AS (SELECT q.query_id, p, b.cluster_id AS code, {_dist('q.q[4 * p + 1 : 4 * p + 4]', 'b.centroid[4 * p + 1 : 4 * p + 4]')} AS d FROM queries q, means b, range(0, 16) r(p)),
approx AS (SELECT query_id, vec_id, round(sum(d), 6) AS dist FROM codes JOIN cells USING (p, code) GROUP BY ALL)"""


def _book(t: Tables) -> quantiser.Book:
    """16 parts, each with the slices of the labels' means (in the order of the labels, from 0)."""
    rows = t.means().orderBy("cluster_id").collect()  # one a label
    return quantiser.Book.of_centroids([r["centroid"] for r in rows], 16)


def _codes(t: Tables) -> DataFrame:
    return quantiser.encode(t.vectors, _book(t), digits=9)


def _adc(t: Tables, k: int) -> DataFrame:
    book = _book(t)
    return quantiser.adc_search(t.queries, quantiser.encode(t.vectors, book, digits=9), book, k, digits=6)


@register("pq_encode_fixed_codebook", f", {_CODES} SELECT vec_id, CAST(p AS INT) AS part, CAST(code AS INT) AS code FROM codes")
def _(t: Tables) -> DataFrame:
    return quantiser.spelled(_codes(t))


@register("adc_topk", f", {_ADC} {_ranked('SELECT * FROM approx', 40)}")
def _(t: Tables) -> DataFrame:
    return _near(_adc(t, 40))


@register("adc_rerank", f", {_ADC}, short AS ({_ranked('SELECT * FROM approx', 400)}) {_ranked('SELECT query_id, vec_id, p.dist FROM short JOIN pairs p USING (query_id, vec_id)')}")
def _(t: Tables) -> DataFrame:
    short = _adc(t, 400).select("query_id", "vec_id")
    full = short.join(t.vectors, "vec_id").join(t.queries, "query_id")
    return _near(knn.top_k(knn._scored(full, distance.l2_squared), K))



@register("neighbour_graph", f"SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INT) AS rank, dst, round(dist, 6) AS dist FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {_dist('a.embedding', 'b.embedding')} AS dist FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) QUALIFY rank <= 8")
def _(t: Tables) -> DataFrame:
    return cluster.neighbour_graph(t.vectors, 8).select("src", F.col("rank").cast("int").alias("rank"), "dst", F.round("dist", 6).alias("dist"))


# Evaluation


@register("truth_cutoff", "SELECT query_id, round(max(dist), 6) AS cutoff FROM truth GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    return evaluate.cutoffs(knn.unfiltered(t.queries, t.vectors, K)).withColumn("cutoff", F.round("cutoff", 6))


_FOUND = f"found AS (SELECT query_id, vec_id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM pairs JOIN queries USING (query_id) JOIN embeddings USING (vec_id) WHERE label = tid OR vec_id % 2 = 0 QUALIFY rank <= {K})"


def _found(t: Tables) -> DataFrame:
    pairs = knn.meet(t.labelled, t.rows).where("label = tid or vec_id % 2 = 0").drop("label", "tid")
    return knn.top_k(knn._scored(pairs, distance.l2_squared), K)


@register("recall_strict", f", {_FOUND} SELECT query_id, count(t.vec_id) AS hits, CAST({K} AS BIGINT) AS n_truth, count(t.vec_id) / {K}.0 AS recall, FALSE AS empty_truth FROM found LEFT JOIN truth t USING (query_id, vec_id) GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    return evaluate.recall(t.queries, _found(t), knn.unfiltered(t.queries, t.vectors, K))


@register("recall_tie_aware", f", {_FOUND} SELECT query_id, CAST({K} AS BIGINT) AS n_truth, least(1.0, count(*) FILTER (WHERE dist <= cut + 1e-9) / {K}.0) AS recall FROM found JOIN (SELECT query_id, max(dist) AS cut FROM truth GROUP BY query_id) USING (query_id) GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    return evaluate.recall_with_ties(t.queries, _found(t), knn.unfiltered(t.queries, t.vectors, K))


@register("mrr", f", {_FOUND} SELECT query_id, coalesce(1.0 / min(f.rank) FILTER (WHERE t.vec_id IS NOT NULL), 0.0) AS rr FROM found f LEFT JOIN truth t USING (query_id, vec_id) GROUP BY query_id")
def _(t: Tables) -> DataFrame:
    return evaluate.reciprocal_rank(_found(t), knn.unfiltered(t.queries, t.vectors, K))



@register("recall_summary", "SELECT run_id % 5 AS g, count(recall) AS n, round(avg(recall), 6) AS mean, min(recall) AS least, max(recall) AS most, round(quantile_cont(recall, 0.5), 6) AS median, round(quantile_cont(recall, 0.9), 6) AS p90, round(stddev_pop(recall), 6) AS sd, count(*) FILTER (WHERE recall >= 1) AS n_perfect FROM runs GROUP BY g")
def _(t: Tables) -> DataFrame:
    out = evaluate.summary(t.runs.withColumn("g", F.col("run_id") % 5), "recall", "g")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "p90", "sd")})


@register("latency_percentiles", "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, min(value) AS min_ms, max(value) AS max_ms, round(1000 / avg(value), 4) AS qps FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    out = evaluate.latencies(t.table("events"), "value", "event_type")
    return out.withColumns({"mean_ms": F.round("mean_ms", 4), "qps": F.round("qps", 4)} | {f"p{p}_ms": F.round(f"p{p}_ms", 6) for p in (50, 95, 99)})


_TARGETS = ", shares AS (SELECT tid, count(DISTINCT vec_id) / (SELECT count(*) FROM embeddings) AS s FROM access GROUP BY tid), targets AS (SELECT unnest([1, 25, 50, 75, 99]) AS target, unnest(quantile_cont(s, [0.01, 0.25, 0.5, 0.75, 0.99])) AS v FROM shares)"


@register("percentile_targets", f"{_TARGETS} SELECT target, round(v, 9) AS value FROM targets")
def _(t: Tables) -> DataFrame:
    return evaluate.percentile_targets(acc.selectivity(t.vectors, t.grants), "selectivity").withColumn("value", F.round("value", 9))


@register("percentile_buckets", f"{_TARGETS} SELECT query_id, tid, arg_min(target, (round(abs(v - s), 12), target)) AS bucket FROM queries JOIN shares USING (tid), targets GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    shares = acc.selectivity(t.vectors, t.grants)
    asked = t.labelled.join(shares, "tid").select("query_id", "tid", "selectivity")
    return evaluate.nearest_bucket(asked, "selectivity", evaluate.percentile_targets(shares, "selectivity")).select("query_id", "tid", "bucket")



@register("stratified_queries", "SELECT vec_id, b AS bucket FROM (SELECT vec_id, CAST(least(greatest(floor((vec_id % 100) / 20) + 1, 1), 5) AS BIGINT) AS b FROM embeddings) QUALIFY row_number() OVER (PARTITION BY b ORDER BY vec_id * 7919 % 1000, vec_id) <= 7")
def _(t: Tables) -> DataFrame:
    rows = t.vectors.select("vec_id", evaluate.bucket_of((F.col("vec_id") % 100).cast("double"), 0.0, 100.0, 5).cast("long").alias("bucket"))
    return workload.stratified(rows, "bucket", 7, F.struct(F.col("vec_id") * 7919 % 1000, "vec_id"))


@register("proportional_queries", "SELECT vec_id, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS c, row_number() OVER (PARTITION BY label ORDER BY vec_id * 7919 % 1000, vec_id) AS r, count(*) OVER () AS n FROM embeddings) WHERE r <= greatest(1, floor(60 * c / n))")
def _(t: Tables) -> DataFrame:
    return workload.proportional(t.rows.select("vec_id", "label"), "label", 60, F.struct(F.col("vec_id") * 7919 % 1000, "vec_id"))


@register("pareto_frontier", "SELECT run_id, recall, qps FROM (SELECT recall, max(qps) AS qps, arg_max(run_id, (qps, -run_id)) AS run_id FROM (SELECT run_id, round(recall, 9) AS recall, qps FROM runs) GROUP BY recall) QUALIFY qps > coalesce(max(qps) OVER (ORDER BY recall DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)")
def _(t: Tables) -> DataFrame:
    return evaluate.frontier(t.runs)


@register("latency_at_recall", "SELECT g, round(exp(ln(a) + (0.51 - r) / (r2 - r) * (ln(b) - ln(a))), 6) AS latency_ms FROM (SELECT g, recall AS r, a, lead(recall) OVER w AS r2, lead(a) OVER w AS b FROM (SELECT run_id % 3 AS g, recall, min(1000 / qps) AS a FROM runs GROUP BY ALL) WINDOW w AS (PARTITION BY g ORDER BY recall)) WHERE r < 0.51 AND r2 > 0.51")
def _(t: Tables) -> DataFrame:
    points = t.runs.groupBy((F.col("run_id") % 3).alias("g"), "recall").agg(F.min(1000 / F.col("qps")).alias("latency_ms"))
    return evaluate.latency_at(points, 0.51, ("g",)).withColumn("latency_ms", F.round("latency_ms", 6))


@register("sweep_upsert", "SELECT run_id, recall, CASE WHEN run_id % 3 = 0 THEN 1.5 ELSE qps END AS qps FROM runs UNION ALL SELECT run_id + 1000000, recall, 2.5 FROM runs WHERE run_id < 10")
def _(t: Tables) -> DataFrame:
    new = t.runs.where("run_id % 3 = 0").withColumn("qps", F.lit(1.5)).unionByName(t.runs.where("run_id < 10").select((F.col("run_id") + 1000000).alias("run_id"), "recall", F.lit(2.5).alias("qps")))
    return evaluate.upsert(t.runs, new, "run_id")


@register("reevaluate_runs", f"SELECT run, round(avg(hits / {K}.0), 9) AS recall FROM (SELECT query_id // 20 % 4 AS run, query_id, count(*) FILTER (WHERE label = query_id % 10 OR vec_id % 2 = 0) AS hits FROM truth JOIN embeddings USING (vec_id) GROUP BY ALL) GROUP BY run")
def _(t: Tables) -> DataFrame:
    truth = knn.unfiltered(t.queries, t.vectors, K)
    stored = formats.nested(truth.join(t.rows.select("vec_id", "label"), "vec_id").where("label = query_id % 10 or vec_id % 2 = 0"))
    scored = evaluate.recall(t.queries, formats.flat(stored), truth)
    return scored.groupBy(F.expr("query_id div 20 % 4").alias("run")).agg(F.round(F.avg("recall"), 9).alias("recall"))


@register("three_buckets", "SELECT DISTINCT l_linenumber AS bucket FROM lineitem WHERE l_linenumber IN (1, 4, 7)")
def _(t: Tables) -> DataFrame:
    return evaluate.three_buckets(t.table("lineitem").select(F.col("l_linenumber").alias("bucket")), "bucket")


@register("posting_histogram", "SELECT CAST(floor(s / 10) * 10 AS BIGINT) AS low, count(*) AS n FROM (SELECT l_suppkey, count(*) AS s FROM lineitem GROUP BY 1) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return evaluate.posting_histogram(t.table("lineitem"), "l_suppkey", 10)


@register("caption_coalesce", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE lang END), ''), nullif(trim(source), '')) AS text FROM documents")
def _(t: Tables) -> DataFrame:
    first = F.when(F.col("doc_id") % 2 == 0, " ").otherwise(F.col("lang"))
    return t.table("documents").select("doc_id", F.coalesce(F.nullif(F.trim(first), F.lit("")), F.nullif(F.trim("source"), F.lit(""))).alias("text"))


@register("scaled_label_counts", ", w AS (SELECT CAST(i AS INT) AS tid, pow(i + 1, -0.85) AS p FROM range(0, 20) r(i)), x AS (SELECT tid, p / sum(p) OVER () * 1000 AS x FROM w) SELECT tid, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, tid) <= 1000 - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n FROM x")
def _(t: Tables) -> DataFrame:
    return workload.scaled_counts(workload.zipf(t.spark, 20, 0.85, 0.0, 1.0), 1000)


@register("soft_labels", f"SELECT vec_id, cluster_id AS tid FROM ({_NEAREST}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), cluster_id) <= 3")
def _(t: Tables) -> DataFrame:
    return cluster.assign(t.vectors, t.means(), 3).select("vec_id", F.col("cluster_id").alias("tid"))
