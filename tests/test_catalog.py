import os

import duckdb
import pytest

import __spark_entry__ as entry
from vexil import registry

SMALL = "/root/testdata/sf0.001"
TABLES = [x.removesuffix(".parquet") for x in sorted(os.listdir(SMALL)) if x.endswith(".parquet")]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def _rows(df):
    out = df.copy()
    for c in out.columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(6) + 0.0
        elif out[c].dtype == object:
            out[c] = [None if v is None or v != v else float(v) if type(v).__name__ == "Decimal" else v for v in out[c]]
    return sorted(tuple("" if v is None or v != v else v if isinstance(v, (str, bool)) else round(float(v), 6) for v in r) for r in out.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, sql, name):
    want = sql.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert _rows(got[columns]) == _rows(want[columns])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["frontier_search", "best_first", "ivf_probe_knn", "ivf_tuned", "spann_like", "tree_beam_knn", "adc_rerank", "pq_trained"])
def test_recall_of_inexact_searches(spark, name):
    truth = {(r.query_id, r.vec_id) for r in registry.QUERIES["knn_unfiltered"](spark, SMALL).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, SMALL).collect()}
    assert len(found & truth) >= 0.9 * len(truth)


@pytest.mark.parametrize("name", ["index_clusters", "index_codes", "postfilter_overfetch"])
def test_recall_under_labels(spark, name):
    truth = {(r.query_id, r.vec_id) for r in registry.QUERIES["knn_single_label"](spark, SMALL).collect()}
    found = {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, SMALL).collect()}
    assert len(found & truth) >= 0.9 * len(truth)


def test_recall_of_the_partitioned_graph(spark):
    edges = [{(r.src, r.dst) for r in registry.QUERIES[name](spark, SMALL).collect()} for name in ("neighbour_graph", "graph_partitioned")]
    assert len(edges[0] & edges[1]) >= 0.9 * len(edges[0])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """The ranking is cut to k before the shuffle, and the nearest centroid needs none."""
    for name in ("knn_unfiltered", "knn_single_label", "postfilter_overfetch", "adc_topk"):
        assert "WindowGroupLimit" in _plan(registry.QUERIES[name](spark, SMALL)), name
    from vexil.catalog import Tables
    from vexil.operators import cluster

    t = Tables(spark, SMALL)
    means = spark.createDataFrame([(i, [float(i)] * 64) for i in range(4)], "cluster_id int, centroid array<double>")
    assigned = _plan(cluster.assign(t.vectors, means))
    assert "hashpartitioning" not in assigned and "rangepartitioning" not in assigned
    read = _plan(registry.QUERIES["label_selectivity"](spark, SMALL))
    assert "ReadSchema: struct<vec_id:bigint,embedding" not in read
