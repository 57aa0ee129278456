import numpy as np
import pytest

from vexil.operators import evaluate
from vexil.sources import formats, truth
from vexil.streaming import updates


def test_vector_files_round_trip(spark, tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "a.npy", a)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in a))
    (tmp_path / "a.bin").write_bytes(np.array([4, 3], "<i4").tobytes() + a.tobytes())
    (tmp_path / "a.txt").write_text("".join(f"m{i}\t{'|'.join(map(str, r))}\n" for i, r in enumerate(a)))
    for df in (formats.read_npy(spark, str(tmp_path / "a.npy")), formats.read_xvecs(spark, str(tmp_path / "a.fvecs")), formats.read_counted(spark, str(tmp_path / "a.bin"))):
        assert [list(r.embedding) for r in df.orderBy("vec_id").collect()] == a.tolist()
    assert sorted(list(r.embedding) for r in formats.read_text_vectors(spark, str(tmp_path / "a.txt")).collect()) == a.tolist()


def test_results_round_trip_without_padding(spark, tmp_path):
    rows = [(1, 1, 5, 0.5), (1, 2, 6, 0.75), (2, 1, 9, 1.0)]
    df = spark.createDataFrame(rows, "query_id long, rank int, vec_id long, dist double")
    formats.write_results(df, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in formats.read_results(spark, str(tmp_path / "r")).collect()) == rows


def test_stream_and_batch_end_alike(spark, tmp_path):
    means = spark.createDataFrame([(0, [0.0]), (1, [10.0])], "cluster_id int, centroid array<double>")
    log = [("insert", 1, 1, None, [1.0]), ("insert", 2, 2, None, [9.0]), ("delete", 3, 1, None, None), ("insert", 4, 3, None, [11.0]), ("grant", 5, 3, 7, None)]
    spark.createDataFrame(log, updates.CHANGES).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates.follow(stream, means, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    kept = updates.read_log(spark, str(tmp_path / "log"))
    assert {(r.vec_id, r.cluster_id) for r in updates.live_vectors(kept).collect()} == {(2, 1), (3, 1)}
    assert [tuple(r) for r in updates.live_access(kept.select("vec_id", "tid").limit(0), kept).collect()] == [(3, 7)]


def test_truth_files(spark, tmp_path):
    ids = np.array([[3, 1, 2], [5, -1, -1], [7, 8, 9]], np.int32)
    want = [(q, r + 1, int(v)) for q, row in enumerate(ids) for r, v in enumerate(row) if v >= 0]
    (tmp_path / "t.ivecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in ids))
    (tmp_path / "t.bin").write_bytes(np.array([3, 3], "<i4").tobytes() + ids.tobytes())
    (tmp_path / "t.txt").write_text("".join(" ".join(map(str, r)) + " \n" for r in ids))
    for kind, name in (("xvec", "t.ivecs"), ("default", "t.bin"), ("TXT", "t.txt")):
        assert sorted(tuple(r) for r in truth.read(spark, str(tmp_path / name), kind).collect()) == want
        assert truth.read(spark, str(tmp_path / name), kind, 1).count() == 3
        with pytest.raises(Exception, match="too few ids|rows have 3 ids"):
            truth.read(spark, str(tmp_path / name), kind, 4).collect()
    with pytest.raises(ValueError):
        truth.read(spark, "x", "other")
    df = spark.createDataFrame(want, "query_id long, rank int, vec_id long")
    truth.write_text(df, str(tmp_path / "out"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["3 1 2", "5 -1 -1", "7 8 9"]


def test_large_files_are_split(spark, tmp_path):
    a = np.arange(3000, dtype=np.float32).reshape(1000, 3)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(3).tobytes() + r.tobytes() for r in a))
    got = formats.read_large_xvecs(spark, str(tmp_path / "a.fvecs"), 3)
    assert [list(r.embedding) for r in got.orderBy("vec_id").collect()] == a.tolist()
    formats.write_npy(got, str(tmp_path / "b.npy"))
    assert np.load(tmp_path / "b.npy").tolist() == a.tolist()
    formats.write_npy(got.limit(0), str(tmp_path / "c.npy"))
    assert np.load(tmp_path / "c.npy").shape == (0, 0)


def test_damaged_files_raise(spark, tmp_path):
    (tmp_path / "a.fvecs").write_bytes(np.int32(3).tobytes() + b"12345678")
    with pytest.raises(Exception, match="cut off"):
        formats.read_xvecs(spark, str(tmp_path / "a.fvecs")).collect()
    np.save(tmp_path / "c.npy", np.array([1 + 2j]))
    with pytest.raises(Exception, match="isn't read"):
        formats.read_npy(spark, str(tmp_path / "c.npy")).collect()


def test_captions_queries_and_export(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tb\tc\n \tx\ty\nq\t\tr\n\t\t\n")
    assert sorted(r.text for r in formats.read_captions(spark, str(tmp_path / "c.tsv"), ["a", "b", "c"]).collect()) == ["q", "x"]
    lines = spark.createDataFrame([("$k:10 $meta:x:y 1|2.5|3",), ("#AQI=",)], "value string")
    rows = formats.parse_queries(lines).collect()
    assert rows[0].options == {"k": "10", "meta": "x:y"} and rows[0].q == [1.0, 2.5, 3.0] and rows[0].packed is None
    assert bytes(rows[1].packed) == b"\x01\x02" and rows[1].q is None
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    formats.write_npy(vectors, str(tmp_path / "v.npy"))
    assert np.load(tmp_path / "v.npy").tolist() == [[1.0, 2.0], [3.0, 4.0]]


def test_postings_follow_a_stream(spark, tmp_path):
    means = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.0, 10.0])], "cluster_id int, centroid array<double>")
    log = [("insert", 1, 1, None, [5.0, 0.1]), ("insert", 2, 2, None, [0.0, 0.0]), ("insert", 3, 1, None, [0.0, 9.0]), ("insert", 4, 3, None, [4.9, 4.9]), ("delete", 5, 2, None, None)]
    spark.createDataFrame(log, updates.CHANGES).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(updates.CHANGES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates.follow_postings(stream, means, str(tmp_path / "p"), str(tmp_path / "cp"), 3).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "p"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    live = {(r.vec_id, r.cluster_id) for r in updates.live_postings(rows, batch).collect()}
    assert {v for v, _ in live} == {1, 3} and {c for v, c in live if v == 1} == {0, 2} and (3, 0) in live


def test_snapshots(spark, tmp_path):
    early = [("insert", 1, 1, None, [1.0]), ("insert", 2, 2, None, [2.0]), ("grant", 3, 1, 5, None), ("grant", 4, 2, 5, None)]
    late = [("delete", 5, 1, None, None), ("insert", 6, 2, None, [3.0]), ("revoke", 7, 2, 5, None), ("insert", 8, 4, None, [4.0]), ("grant", 9, 4, 6, None)]
    log = spark.createDataFrame(early, updates.CHANGES).selectExpr("*", "0 as cluster_id")
    whole = spark.createDataFrame(early + late, updates.CHANGES).selectExpr("*", "0 as cluster_id")
    none = whole.select("vec_id", "tid").limit(0)
    assert updates.snapshot(log, none, str(tmp_path / "s")) == 4
    vectors, access = updates.restore(spark, str(tmp_path / "s"), whole)
    assert {(r.vec_id, r.embedding[0]) for r in vectors.collect()} == {(r.vec_id, r.embedding[0]) for r in updates.live_vectors(whole).collect()} == {(2, 3.0), (4, 4.0)}
    assert {tuple(r) for r in access.collect()} == {tuple(r) for r in updates.live_access(none, whole).collect()} == {(1, 5), (4, 6)}


def test_compaction_splits_merges_and_places(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=2) + [20 * (i % 2), 0]).tolist(), 0) for i in range(200)] + [(1000, [50.0, 50.0], 7)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster_id int")
    means = spark.createDataFrame([(0, [10.0, 0.0]), (7, [50.0, 50.0]), (8, [90.0, 90.0])], "cluster_id int, centroid array<double>")
    moved, placed = updates.compact(vectors, means, 150, 1)
    sizes = {r.cluster_id: r["count"] for r in placed.groupBy("cluster_id").count().collect()}
    assert sorted(sizes.values()) == [1, 100, 100] and 8 not in sizes
    assert updates.misplaced(placed, moved).count() == 0
    assert updates.compact(vectors, means, 1000, 500)[1].count() == 201


def test_late_events_are_counted_apart(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "a"), ("2024-01-01 10:50:00", "a"), ("2024-01-01 11:10:00", "b")]
    df = spark.createDataFrame(rows, "ts string, event_type string").selectExpr("cast(ts as timestamp) ts", "event_type")
    assert sorted((r.start.hour, r.event_type, r.n) for r in updates.late_counts(df).collect()) == [(10, "a", 2), (11, "b", 1)]


def test_metadata_and_results_by_filter(spark, tmp_path):
    values = [b"a", b"", b"\xff\x00", "é".encode()]
    places = np.cumsum([0, *map(len, values)]).astype("<u8")
    (tmp_path / "m.bin").write_bytes(b"".join(values))
    (tmp_path / "i.bin").write_bytes(np.int32(4).tobytes() + places.tobytes())
    assert [(r.vec_id, bytes(r.meta)) for r in formats.read_metadata(spark, str(tmp_path / "m.bin"), str(tmp_path / "i.bin")).orderBy("vec_id").collect()] == list(enumerate(values))
    rows = [("OR 1 2", 1, 1, 5, 0.5, 10), ("OR 1 2", 1, 2, 6, 0.75, 10), ("NOT 1", 1, 1, 9, 1.0, 20), ("OR 1 2", 2, 1, 7, 0.0, 30)]
    df = spark.createDataFrame(rows, "filter string, query_id long, rank int, vec_id long, dist double, search_time_us long")
    nested = formats.nested_by_filter(df)
    nested.write.json(str(tmp_path / "r"))
    again = spark.read.schema(nested.schema).json(str(tmp_path / "r"))
    assert sorted(tuple(r) for r in formats.flat_by_filter(again).select(*df.columns).collect()) == sorted(rows)


def test_percentiles_of_ranges(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.exponential(size=3000), 2)
    g = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(int(a) if a else None, float(b)) for a, b in zip(g, x)] + [(1, None)], "g int, x double")
    got = {(r.g or 0, r.share): r.value for r in evaluate.percentiles(df, "x", [0.0, 0.37, 0.5, 1.0], "g").collect()}
    assert got == pytest.approx({(k, p): np.percentile(x[g == k], p * 100) for k in range(3) for p in (0.0, 0.37, 0.5, 1.0)})
    assert evaluate.percentiles(df, "x", [0.5]).first()["value"] == pytest.approx(np.median(x))
    assert evaluate.percentiles(df.limit(0), "x", [0.5], "g").count() == 0
