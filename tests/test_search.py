import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.functions.distance import METRICS
from vexil.operators import access, cluster, evaluate, knn, workload


@pytest.fixture(scope="module")
def line(spark):
    """vec_i = (i, ..., i), so that neighbours are known in closed form."""
    return spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda _: F.col("id").cast("float")).alias("embedding")).cache()


@pytest.fixture(scope="module")
def asked(line):
    return line.where("vec_id in (0, 2, 4)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).cache()


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_line_neighbours(line, asked):
    assert ids(knn.unfiltered(asked, line, 3)) == {0: [0, 1, 2], 2: [2, 1, 3], 4: [4, 3, 5]}
    assert ids(knn.blocked(asked, line, 3)) == ids(knn.unfiltered(asked, line, 3))


def test_labels_unknown_null_and_short(spark, line, asked):
    grants = spark.createDataFrame([(5, 1), (5, 1), (9, 1)], "vec_id long, tid int")
    queries = asked.withColumn("tid", F.when(F.col("query_id") == 0, 1).when(F.col("query_id") == 2, 77))
    found = ids(knn.single_label(queries, line, grants, 3))
    assert found == {0: [5, 9], 4: [4, 3, 5]}


def test_many_queries_take_the_dealt_path(monkeypatch, line, asked):
    want = ids(knn.unfiltered(asked, line, 3))
    monkeypatch.setattr(knn, "SENT_QUERIES", 0)
    assert ids(knn.unfiltered(asked, line, 3)) == want


def test_probe_of_all_clusters_is_exact_and_beam_too(line, asked):
    means, assigned = cluster.kmeans(line, 4, 3)
    placed = line.join(assigned.select("vec_id", "cluster_id"), "vec_id")
    want = ids(knn.unfiltered(asked, line, 3))
    assert ids(cluster.probe(asked, placed, means, 4, 3)) == want
    nodes, paths = cluster.tree(line, 3, 1, 20)
    assert ids(cluster.beam(asked, line, nodes, paths, 10, 3)) == want


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((2, 6))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    m = (a + b) / 2
    want = {"l2": ((a - b) ** 2).sum(), "ip": 1 - a @ b, "cosine": 1 - a @ b / np.sqrt(a @ a * (b @ b)), "l1": abs(a - b).sum(), "linf": abs(a - b).max(), "l3": (abs(a - b) ** 3).sum() ** (1 / 3)}
    want |= {"canberra": (abs(a - b) / (a + b)).sum(), "bray_curtis": abs(a - b).sum() / (a + b).sum(), "jaccard": 1 - np.minimum(a, b).sum() / np.maximum(a, b).sum()}
    want["jensen_shannon"] = 0.5 * ((a * np.log(a / m)).sum() + (b * np.log(b / m)).sum())
    got = df.select(*(f(F.col("a"), F.col("b")).alias(n) for n, f in METRICS.items())).first()
    for n, w in want.items():
        assert got[n] == pytest.approx(w), n


def test_recall_of_the_exact_is_one_and_empty_truth_is_marked(spark, line, asked):
    truth = knn.unfiltered(asked, line, 3)
    assert {r.recall for r in evaluate.recall(asked, truth, truth).collect()} == {1.0}
    none = evaluate.recall(asked, truth, truth.where("query_id = 0")).where("empty_truth").collect()
    assert len(none) == 2 and all(r.recall == 1 for r in none)


def test_log_of_grants_last_wins(spark):
    base = spark.createDataFrame([(1, 1), (2, 1)], "vec_id long, tid int")
    log = spark.createDataFrame([(1, 1, "revoke", 1), (1, 1, "grant", 2), (2, 1, "revoke", 3), (3, 4, "grant", 1)], "vec_id long, tid int, op string, seq long")
    assert {tuple(r) for r in access.apply_log(base, log).collect()} == {(1, 1), (3, 4)}


def test_exact_labels_have_their_counts(spark, line):
    counts = workload.scaled_counts(workload.zipf(spark, 5, 1.0, 0.0, 1.0), 300)
    assert counts.agg(F.sum("n")).first()[0] == 300
    labels = workload.exact_labels(line, counts).groupBy("tid").count()
    assert {r.tid: r["count"] for r in labels.collect()} == {r.tid: min(200, r.n) for r in counts.collect()}


def test_ties_of_many_equal_vectors_go_to_the_smallest_ids(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 2 else rng.normal(size=3).tolist()) for i in rng.permutation(600).tolist()] + [(5000, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(0, [1.0, 2.0, 3.0], 1), (1, [1.0, 2.0, 3.5], None), (2, [0.0, 0.0, 0.0], 2), (3, [1.0, 2.0, 3.0], 9)], "query_id long, q array<double>, tid int")
    grants = spark.createDataFrame([(i, 1) for i in range(100, 600)] + [(i, 2) for i in range(0, 600, 2)] * 2, "vec_id long, tid int")
    v = {i: np.array(x) for i, x in rows if x}

    def near(q, ids):
        return sorted(ids, key=lambda i: (((np.array(q) - v[i]) ** 2).sum(), i))[:7]

    for cells in (knn._CELLS, 50):
        monkeypatch.setattr(knn, "_CELLS", cells)
        assert ids(knn.unfiltered(queries, vectors, 7)) == {r.query_id: near(r.q, v) for r in queries.collect()}
        got = ids(knn.single_label(queries, vectors, grants, 7))
        assert got == {0: near([1.0, 2.0, 3.0], range(100, 600)), 1: near([1.0, 2.0, 3.5], v), 2: near([0.0] * 3, range(0, 600, 2))}
    assert knn.unfiltered(queries.limit(0), vectors, 3).count() == 0 and knn.single_label(queries, vectors.limit(0), grants, 3).count() == 0
