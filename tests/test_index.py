import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil import cli
from vexil.index import VectorIndex
from vexil.operators import cluster, knn, quantiser, selectors, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 3
    v = (centres[np.arange(600) % 6] + rng.normal(size=(600, 16))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    grants = spark.createDataFrame([(i, i % 5) for i in range(600)] + [(i, 9) for i in range(0, 600, 2)], "vec_id long, tid int").cache()
    return v, vectors, grants


@pytest.fixture(scope="module")
def index(spark, data):
    out = VectorIndex(spark, clusters=6, probes=3, parts=8, codes=32)
    out.batch_create(data[1], data[2])
    return out


def brute(v, q, ids, k):
    ids = np.array(sorted(ids))
    d = ((v[ids].astype(float) - np.asarray(q, float)) ** 2).sum(1)
    return ids[np.lexsort((ids, d))][:k].tolist()


def test_searches_of_the_index(index, data):
    v = data[0]
    q = v[3] + 0.1
    assert index.query(q.tolist(), 5, 9) == brute(v, q, range(0, 600, 2), 5)
    assert index.query(q.tolist(), 5) == index.query(q.tolist(), 5, -1) == index.query_unfiltered(q.tolist(), 5) == brute(v, q, range(600), 5)
    assert index.query(q.tolist(), 5, 77) == []
    both = [i for i in range(600) if i % 5 == 1 and i % 2]
    assert index.query_with_complex_predicate(q.tolist(), 5, "AND 1 NOT 9") == index.query_with_complex_predicate(q.tolist(), 5, "1 9 NOT AND", "postfix") == brute(v, q, both, 5)
    pages = list(index.iterate(q.tolist(), 4, 10))
    assert [len(p) for p in pages] == [4, 4, 2] and sum(pages, []) == brute(v, q, range(600), 10)
    chosen = index.select_query(index._one(q.tolist()), 5, selectors.id_range(100, 300) & ~selectors.id_list([120]))
    assert index._ids(chosen) == brute(v, q, [i for i in range(100, 300) if i != 120], 5)


def test_changes_deletions_and_files(spark, data, tmp_path):
    v, vectors, grants = data
    index = VectorIndex(spark, clusters=4, probes=4, parts=4, codes=16)
    with pytest.raises(ValueError):
        index.create(1, [0.0] * 16)
    index.batch_create(vectors.where("vec_id < 300"), grants.where("vec_id < 300"))
    index.create(1000, v[7].tolist(), [3])
    index.grant_access(7, 3)
    index.revoke_access(3, 3)
    index.delete_vector(8)
    index.create(8, v[8].tolist(), [3])
    index.delete_vector(13)
    index.grant_access(4000, 3)
    allowed = {i for i in range(300) if i % 5 == 3} - {3, 13} | {7, 8}
    got = index.query(v[7].tolist(), 400, 3)
    assert set(got) == allowed | {1000} and got[:2] == [7, 1000]
    assert 9 not in index.statistics()["labels"].where("tid = 9").join(index.access.where("vec_id = 8"), "tid").select("tid").collect()
    index.delete_where(selectors.where(F.col("kind") == "odd"), vectors.select("vec_id", F.when(F.col("vec_id") % 2 == 1, "odd").alias("kind")))
    assert set(index.query(v[7].tolist(), 400, 3)) == {i for i in allowed if i % 2 == 0} | {1000}
    before = index.query(v[7].tolist(), 10, 3)
    index.index_filter("OR 3 4")
    index.save(str(tmp_path / "i"))
    again = VectorIndex.load(spark, str(tmp_path / "i"))
    assert again.query(v[7].tolist(), 10, 3) == before and again.filters == index.filters
    assert {r["vec_id"]: bytes(r["codes"]) for r in again.vectors.collect()} == {r["vec_id"]: bytes(r["codes"]) for r in index.vectors.collect()}
    again.create(2000, v[9].tolist(), [3])
    assert 2000 in again.query(v[9].tolist(), 3, 3)
    again.refine(3)
    assert set(again.query(v[7].tolist(), 400, 3)) == set(index.query(v[7].tolist(), 400, 3)) | {2000}
    memory = {r["component"]: r["bytes"] for r in index.statistics()["memory"].collect()}
    n = index.vectors.count()
    assert memory["vectors"] == n * 16 * 4 and memory["codes"] == n * 4


@pytest.mark.parametrize("strategy", ["clusters", "codes", "overfetch"])
def test_strategies_find_most(spark, data, strategy):
    v, vectors, grants = data
    index = VectorIndex(spark, clusters=6, probes=3, parts=8, codes=64, factor=8, strategy=strategy)
    index.batch_create(vectors, grants)
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.when(F.col("vec_id") % 40 == 0, 9).otherwise(-1).alias("tid"))
    got = {}
    for r in index.batch_query(asked, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {i: set(brute(v, v[i], range(0, 600, 2) if i % 40 == 0 else range(600), 5)) for i in range(0, 600, 20)}
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 5 * len(want)


def test_codebooks(spark, data):
    v, vectors, _ = data
    book = quantiser.train(vectors, 8, 32)
    codes = quantiser.encode(vectors, book)
    fine = quantiser.distortion(vectors, codes, book)
    rough = quantiser.train(vectors, 8, 2)
    assert fine < 0.5 * quantiser.distortion(vectors, quantiser.encode(vectors, rough), rough)
    turned = quantiser.train(vectors, 8, 32, rotation=quantiser.random_rotation(16))
    assert quantiser.distortion(vectors, quantiser.encode(vectors, turned), turned) < 2 * fine
    row = book.encode(v[:3].astype(float))
    assert (book.symmetric(row, row) == 0).all()
    exact = ((v[:3, None].reshape(3, 1, 8, 2) - book.decode(row).reshape(1, 3, 8, 2)) ** 2).sum((2, 3))
    tables = book.tables(v[:3].astype(float))
    assert np.allclose([[tables[i, np.arange(8), row[j]].sum() for j in range(3)] for i in range(3)], exact)
    with pytest.raises(ValueError):
        quantiser.train(vectors, 7)
    with pytest.raises(ValueError):
        quantiser.train(vectors, 8, 300)


def test_many_queries_are_asked_in_blocks(data, monkeypatch):
    v, vectors, grants = data
    book = quantiser.train(vectors, 4, 8)
    codes = quantiser.encode(vectors, book).cache()
    asked = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    allowed = grants.where("tid = 9").select("vec_id").crossJoin(asked.select("query_id")).where("(vec_id + query_id) % 3 = 0")
    want = [sorted(tuple(r) for r in quantiser.adc_search(asked, codes, book, 3, allowed=x).collect()) for x in (None, allowed)]
    assert len(want[0]) == 180 and all((r[0] + r[2]) % 3 == 0 for r in want[1])
    monkeypatch.setattr(quantiser, "TABLE_BYTES", 4 * 8 * 8 * 7)
    assert [sorted(tuple(r) for r in quantiser.adc_search(asked, codes, book, 3, allowed=x).collect()) for x in (None, allowed)] == want


def test_clusters_settle_and_balance(spark, data):
    v, vectors, _ = data
    means, assigned = cluster.kmeans(vectors, 6, 20)
    rows = {r["cluster_id"]: np.array(r["centroid"]) for r in means.collect()}
    at = {r["vec_id"]: r["cluster_id"] for r in assigned.collect()}
    near = {i: min(rows, key=lambda c: (((v[i] - rows[c]) ** 2).sum(), c)) for i in range(600)}
    assert at == near
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(500, 2)) * 0.5, rng.normal(size=(100, 2)) + [6, 0], rng.normal(size=(100, 2)) + [0, 6]])
    uneven = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>").cache()
    spread = [np.std([r["count"] for r in cluster.balanced_kmeans(uneven, 5, w, 20)[1].groupBy("cluster_id").count().collect()]) for w in (0.0, 1.0)]
    assert spread[1] < spread[0]


def test_trees(spark, data):
    v, vectors, _ = data
    nodes, paths = cluster.tree(vectors, 3, 2, 50)
    leaf = {r["vec_id"]: r["leaf"] for r in trees.leaf_of(paths).collect()}
    placed = {r["vec_id"]: r["leaf"] for r in trees.insert(vectors, nodes).collect()}
    assert sum(leaf[i] == placed[i] for i in leaf) >= 0.9 * len(leaf)
    with pytest.raises(ValueError):
        trees.insert(vectors, nodes, capacity=2)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    want = {(r.query_id, r.rank, r.vec_id) for r in knn.unfiltered(asked, vectors, 4).collect()}
    cuts = trees.kd_tree(vectors, 4)
    assert {(r.query_id, r.rank, r.vec_id) for r in trees.kd_probe(asked, vectors, cuts, 4).collect()} == want
    assert trees.kd_leaf(vectors, cuts).select("node").distinct().count() > 8
    same = vectors.select("vec_id", F.array(*(F.lit(1.0) for _ in range(16))).alias("embedding"))
    assert trees.kd_tree(same, 3).count() == 0 and trees.kd_probe(asked, same, trees.kd_tree(same, 3), 4).count() == 4 * 12


def test_blooms(spark):
    rows = spark.createDataFrame([(g, t) for g in range(3) for t in range(g * 100, g * 100 + 40)], "g int, tid int")
    made = trees.bloom(rows, "g", bits=512)
    pairs = made.crossJoin(spark.range(400).select(F.col("id").cast("int").alias("tid"))).withColumn("may", trees.may_hold("words", "tid"))
    got = {(r.g, r.tid): r.may for r in pairs.collect()}
    assert all(got[g, t] for g in range(3) for t in range(g * 100, g * 100 + 40))
    assert sum(got.values()) < 0.4 * len(got)
    a, b = (made.where(f"g = {g}").select(F.col("words").alias(f"w{g}")) for g in (0, 1))
    both = a.crossJoin(b).select(trees.combined("w0", "w1", "union").alias("u"), trees.combined("w0", "w1", "intersection").alias("i"), trees.combined("w0", "w1", "xor").alias("x"), "w0", "w1").first()
    assert all(x | y == u and x & y == i and x ^ y == z for x, y, u, i, z in zip(both.w0, both.w1, both.u, both.i, both.x))


def test_command_line(spark, data, tmp_path, capsys):
    v, _, _ = data
    np.save(tmp_path / "v.npy", v)
    np.save(tmp_path / "a.npy", np.array([(i, i % 5) for i in range(600)], np.int32))
    np.save(tmp_path / "q.npy", v[:20] + 0.01)
    np.save(tmp_path / "l.npy", np.array([i % 5 if i % 4 else -1 for i in range(20)], np.int32)[:, None])
    (tmp_path / "f.txt").write_text("OR 1 2\n\nNOT 3\n")
    path = str(tmp_path / "index")
    out = cli.main(["build", "--train_vecs", str(tmp_path / "v.npy"), "--train_access", str(tmp_path / "a.npy"), "--index", path, "--clusters", "6", "--parts", "8", "--codes", "32", "--strategy", "clusters", "--probes", "4"], spark)
    assert out == {"vectors": 600, "grants": 600}
    one = cli.main(["bench", "--index", path, "--queries", str(tmp_path / "q.npy"), "--query_labels", str(tmp_path / "l.npy"), "--k", "5", "--output", str(tmp_path / "r")], spark)
    assert one["runs"][0]["queries"] == 20 and one["runs"][0]["recall"] > 0.8
    two = cli.main(["search", "--index", path, "--queries", str(tmp_path / "q.npy"), "--filters_file", str(tmp_path / "f.txt")], spark)
    assert [r["filter"] for r in two["runs"]] == ["OR 1 2", "NOT 3"] and all(r["rows"] == 200 for r in two["runs"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == two
