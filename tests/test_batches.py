"""Searches whose queries meet vectors as matrices: no pair of a query and a vector is a row, and results are those of the columns' metrics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil import registry
from vexil.functions.distance import METRICS, lp
from vexil.operators import cluster, knn, trees

SMALL = "/root/testdata/sf0.001"
SEARCHES = {
    "F1": "best_first", "F3": "index_overfetch", "F4": "ivf_all_clusters", "F5": "ivf_allowed", "F6": "ivf_probe_knn", "F7": "knn_bray_curtis", "F8": "knn_canberra", "F9": "knn_l1",
    "F10": "knn_l3", "F11": "knn_multi_index", "F12": "knn_multi_threshold", "F13": "knn_random_predicates", "F14": "knn_sharded", "F15": "knn_within_ratio", "F16": "postfilter_overfetch",
    "F17": "spann_like", "F18": "steady_state", "F19": "store_probe", "F20": "graph_pruned", "F21": "knn_cosine", "F22": "knn_table_function", "F23": "frontier_search", "F24": "kd_exact",
}
#: How many searches a query's plan holds, if not one.
SEVERAL = {"steady_state": 6, "index_overfetch": 2}


@pytest.mark.parametrize("name", SEARCHES.values(), ids=SEARCHES)
def test_no_pair_is_a_row(spark, name):
    plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow run(") >= SEVERAL.get(name, 1)


def test_the_partitioned_graph_has_a_short_plan(spark):
    vectors = spark.range(600).select(F.col("id").alias("vec_id"), F.array(*(F.rand(i).cast("float") for i in range(8))).alias("embedding")).localCheckpoint()
    graph = trees.partition_graph(vectors, 3, trees=6, leaf=40)
    assert len(graph._jdf.queryExecution().analyzed().toString()) < 10_000
    rows = graph.collect()
    assert len(rows) == 1800 and all(r.src != r.dst for r in rows) and len({(r.src, r.dst) for r in rows}) == 1800
    v = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    assert all(r.dist == pytest.approx(((v[r.src] - v[r.dst]) ** 2).sum()) for r in rows)


@pytest.fixture(scope="module")
def tables(spark):
    """Vectors with many copies and a zero one, and a cell for each."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [0.0] * 5 if i == 7 else [0.5, 1.0, 0.25, 2.0, 1.0] if i % 3 == 0 else [float(x) for x in rng.integers(0, 4, 5) / 4], int(i) % 4) for i in rng.permutation(300)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster_id int").repartition(4).localCheckpoint()
    asked = vectors.where("vec_id in (3, 5, 8, 20)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).localCheckpoint()
    return vectors, asked


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.dist) for r in df.collect())


@pytest.mark.parametrize("name", [*METRICS, "l4"])
def test_metrics_rank_as_their_columns_do(monkeypatch, tables, name):
    vectors, asked = tables
    metric = METRICS.get(name) or lp(4)
    pairs = asked.crossJoin(vectors).select("query_id", "vec_id", F.round(metric(F.col("embedding"), F.col("q")), 9).alias("dist"))
    want = found(knn.top_k(pairs.where("dist is not null"), 40))
    for cells in (knn._CELLS, 40):
        monkeypatch.setattr(knn, "_CELLS", cells)
        assert found(knn.unfiltered(asked, vectors, 40, metric, digits=9)) == want


def test_equal_distances_to_the_last_bit(tables):
    vectors, asked = tables
    pairs = asked.crossJoin(vectors).select("query_id", "vec_id", METRICS["l2"](F.col("embedding"), F.col("q")).alias("dist"))
    assert found(knn.unfiltered(asked, vectors, 60)) == found(knn.top_k(pairs, 60))
    assert found(knn.unfiltered(asked, vectors, 60, apart=True)) == found(knn.top_k(pairs.where("dist > 0"), 60))
    parts = [(F.slice("embedding", 1, 2), F.slice("embedding", 3, 3)), (F.slice("q", 1, 2), F.slice("q", 3, 3))]
    two = pairs.select("query_id", "vec_id").join(vectors, "vec_id").join(asked, "query_id")
    two = two.select("query_id", "vec_id", (0.7 * METRICS["l2"](parts[0][0], parts[1][0]) + 0.3 * METRICS["l2"](parts[0][1], parts[1][1])).alias("dist"))
    halves = vectors.select("vec_id", parts[0][0].alias("a"), parts[0][1].alias("b")), asked.select("query_id", parts[1][0].alias("x"), parts[1][1].alias("y"))
    assert found(knn.weighted(halves[1], halves[0], [("a", "x", 0.7), ("b", "y", 0.3)], 60, most=0.4)) == found(knn.top_k(two.where("dist <= 0.4"), 60))


def test_cells_and_allowed_pairs(spark, monkeypatch, tables):
    vectors, asked = tables
    pairs = asked.crossJoin(vectors).select("query_id", "vec_id", "cluster_id", METRICS["l2"](F.col("embedding"), F.col("q")).alias("dist"))
    visits = asked.select("query_id", F.explode(F.array((F.col("query_id") % 4).cast("int"), ((F.col("query_id") + 1) % 4).cast("int"))).alias("cluster_id"))
    seen = pairs.join(visits, ["query_id", "cluster_id"])
    twice = vectors.unionByName(vectors.withColumn("cluster_id", ((F.col("cluster_id") + 1) % 4).cast("int")))
    both = asked.crossJoin(twice).select("query_id", "vec_id", "cluster_id", METRICS["l2"](F.col("embedding"), F.col("q")).alias("dist")).join(visits, ["query_id", "cluster_id"]).select("query_id", "vec_id", "dist").distinct()
    for sent in (knn.SENT_QUERIES, 1):
        monkeypatch.setattr(knn, "SENT_QUERIES", sent)
        assert found(knn.among(asked, visits, vectors, 50)) == found(knn.top_k(seen, 50))
        assert found(knn.among(asked, visits, twice, 50, once=True)) == found(knn.top_k(both, 50))
    means = spark.createDataFrame([(i, [float(i)] * 5) for i in range(4)], "cluster_id int, centroid array<double>")
    rule = cluster.probe(asked, vectors, means, 4, 50, lambda query, vec: (query + vec) % 3 == 0)
    table = cluster.probe(asked, vectors, means, 4, 50, pairs.where("(query_id + vec_id) % 3 = 0"))
    assert found(rule) == found(table) == found(knn.top_k(pairs.where("(query_id + vec_id) % 3 = 0"), 50))


def test_places_in_lists_that_are_not_written(monkeypatch, tables):
    vectors, asked = tables
    whole = knn.unfiltered(asked, vectors, 300)
    some = whole.where("vec_id % 7 = 1")
    want = {(r.query_id, r.vec_id, r["rank"]) for r in some.collect()}
    for cells in (knn._CELLS, 40):
        monkeypatch.setattr(knn, "_CELLS", cells)
        assert {(r.query_id, r.vec_id, r.place) for r in knn.placed(asked, vectors, some).collect()} == want


def test_edges_without_a_vector_neither_go_nor_shade(spark):
    vectors = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1.5])], "vec_id long, embedding array<double>")
    graph = spark.createDataFrame([(0, 1, 1, 1.0), (0, 9, 2, 1.1), (0, 2, 3, 2.25)], "src long, dst long, rank int, dist double")
    assert {(r.src, r.dst) for r in cluster.pruned(graph, vectors).collect()} == {(0, 1), (0, 9)}
