import itertools
import json

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vexil.operators import curves, evaluate, sweeps

POINTS = st.lists(st.tuples(st.integers(0, 20), st.integers(1, 30)), min_size=1, max_size=8, unique_by=lambda p: p[0])


@given(POINTS)
@settings(max_examples=200, deadline=None)
def test_path_is_the_best_of_all(points):
    points = sorted((r / 20, float(q)) for r, q in points)
    recall, qps = (np.array(x) for x in zip(*points))
    path = curves._path(recall, qps)
    value = lambda p: 100 * (recall[p[-1]] - recall[p[0]]) + len(p)
    falls = lambda p: all(qps[a] >= qps[b] for a, b in itertools.pairwise(p))
    every = [p for n in range(1, len(points) + 1) for p in itertools.combinations(range(len(points)), n) if falls(p)]
    assert falls(path) and value(path) == pytest.approx(max(map(value, every)))


def test_cubic_keeps_shape():
    x, y = np.array([0.1, 0.4, 0.5, 0.8, 0.9]), np.array([1.0, 1.5, 1.5, 4.0, 9.0])
    at = np.linspace(0.1, 0.9, 200)
    got = curves.cubic(x, y, at)
    assert np.allclose(curves.cubic(x, y, x), y) and (np.diff(got) >= -1e-12).all()
    assert np.isnan(curves.cubic(x, y, np.array([0.05, 0.95]))).all()
    line = curves.cubic(np.array([0.0, 1.0, 3.0]), np.array([1.0, 3.0, 7.0]), np.array([0.5, 2.0]))
    assert np.allclose(line, [2.0, 5.0])


def test_curves_by_group(spark):
    rows = [("a", r / 10, 100.0 / (1 + r * r)) for r in range(10)] + [("b", 0.1, 5.0), ("b", 0.9, 4.9), ("b", 0.5, 9.0), ("c", 0.3, 2.0)]
    df = spark.createDataFrame(rows, "g string, recall double, qps double")
    kept = {k: sorted(f["recall"]) for k, f in curves.longest_fall(df, ("g",)).toPandas().groupby("g")}
    assert len(kept["a"]) == 10 and kept["b"] == [0.1, 0.9] and kept["c"] == [0.3]
    few = curves.limited(df, 4, ("g",)).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in few} == {"a": 4, "b": 3, "c": 1}
    straight = spark.createDataFrame([(i / 10, float(np.exp(-i))) for i in range(10)], "recall double, qps double")
    assert sorted(r.recall for r in curves.simplified(straight, 0.01).collect()) == [0.0, 0.9]
    flat = spark.createDataFrame([(0.1, 10.0), (0.3, 9.0), (0.6, 8.9), (0.95, 1.0)], "recall double, qps double")
    assert sorted(r.recall for r in curves.without_plateaus(flat).collect()) == [0.1, 0.6, 0.95]
    got = curves.smooth_latency_at(df.withColumn("latency_ms", 1000 / df.qps), [0.5, 0.95], ("g",)).toPandas()
    value = {(r.g, r.target): r.latency_ms for r in got.itertuples()}
    assert value["a", 0.5] == pytest.approx(260.0) and pd.isna(value["a", 0.95]) and pd.isna(value["c", 0.5])


def test_sweep_files(spark, tmp_path):
    entry = {"params": {"nlist": 16, "nprobe": 4}, "latency_ms": 2.0, "qps": 500.0, "avg_recall": 0.9, "per_bucket": {"1p": {"count": 3, "avg_latency_ms": 2.0, "avg_recall": 0.9, "qps": 500.0}}}
    entry["complex_predicate"] = {"n_filters": 1, "per_filter": {"OR 1 2": {"avg_latency_ms": 1.0, "avg_recall": 1.0, "qps": 1000.0}}}
    (tmp_path / "sweep_x.json").write_text(json.dumps({"sweep_results": [entry, {"params": {"nlist": 32}, "latency_ms": 1.0}]}, indent=1))
    runs, buckets, filters = sweeps.read_sweep(spark, str(tmp_path / "sweep_x.json"))
    assert [(r.run_id, r.params, r.latency_ms) for r in runs.orderBy("run_id").collect()] == [("sweep_x.json#0", {"nlist": "16", "nprobe": "4"}, 2.0), ("sweep_x.json#1", {"nlist": "32"}, 1.0)]
    assert [(r.bucket, r["count"], r.qps) for r in buckets.collect()] == [("1p", 3, 500.0)]
    assert [(r["filter"], r.qps) for r in filters.collect()] == [("OR 1 2", 1000.0)]


def test_unknown_times_and_overflow(spark):
    rows = [(1, 1, "a", 0, 1.0), (1, 2, "a", 1000, 0.5), (1, 3, "Overflow", 5000, 0.0), (2, 1, "b", None, 1.0)]
    timed = spark.createDataFrame(rows, "run_id int, query_id int, bucket string, search_time_us long, recall double")
    got = {(r.run_id, r.bucket): (r.n, r.latency_ms, r.qps) for r in sweeps.by_bucket(timed).collect()}
    assert got == {(1, "a"): (2, 1.0, 1000.0), (2, "b"): (1, None, None)}
    assert {r.bucket for r in evaluate.three_buckets(timed, "bucket").collect()} == {"a", "b"}
    peaks = spark.createDataFrame([("x", 5.0, 8), ("x", 9.0, 16), ("y", None, None)], "dataset string, rss double, m int")
    assert {r.dataset: r.peak for r in sweeps.peak(peaks, "rss", "m", 8).collect()} == {"x": 5.0, "y": 0.0}
