"""Queries of recorded sweeps, curves and change logs, and the SQL that they are held against.

Recorded queries are derived from the ids: run vec_id % 8, a search time, a recall, a bucket and a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.catalog import _NEAREST, K, Tables, _dist, _near, _ranked, register
from vexil.operators import curves, evaluate, knn, sweeps, workload
from vexil.streaming import updates

_TIMED = """, timed AS (SELECT vec_id % 8 AS run_id, vec_id AS query_id, CASE WHEN vec_id % 11 = 0 THEN 'overflow' ELSE 'p' || (vec_id % 5) END AS bucket, 'f' || (vec_id % 3) AS filter,
CASE WHEN vec_id % 13 = 0 THEN 0 ELSE 100 + vec_id * 37 % 901 END AS search_time_us, (vec_id % 11) / 10.0 AS recall FROM embeddings)"""
_MEASURES = "count(*) AS n, round(avg(CASE WHEN search_time_us > 0 THEN search_time_us / 1000 END), 6) AS latency_ms, round(avg(recall), 6) AS avg_recall, min(recall) AS min_recall, round(1000.0 / avg(CASE WHEN search_time_us > 0 THEN search_time_us / 1000 END), 6) AS qps"


def _timed(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    bucket = F.when(v % 11 == 0, "overflow").otherwise(F.concat(F.lit("p"), (v % 5).cast("string")))
    us = F.when(v % 13 == 0, 0).otherwise(100 + v * 37 % 901)
    return t.rows.select((v % 8).alias("run_id"), v.alias("query_id"), bucket.alias("bucket"), F.concat(F.lit("f"), (v % 3).cast("string")).alias("filter"), us.alias("search_time_us"), (v % 11 / 10.0).alias("recall"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("latency_ms", "avg_recall", "qps")})


@register("sweep_by_bucket", f"{_TIMED} SELECT run_id, bucket, {_MEASURES} FROM timed WHERE bucket <> 'overflow' GROUP BY run_id, bucket")
def _(t: Tables) -> DataFrame:
    return _rounded(sweeps.by_bucket(_timed(t)))


@register("sweep_overall", f"{_TIMED} SELECT run_id, {_MEASURES} FROM timed GROUP BY run_id")
def _(t: Tables) -> DataFrame:
    return _rounded(sweeps.overall(_timed(t)))


@register("sweep_by_filter", f"{_TIMED} SELECT run_id, filter, {_MEASURES} FROM timed GROUP BY GROUPING SETS ((run_id, filter), (run_id))")
def _(t: Tables) -> DataFrame:
    return _rounded(sweeps.by_filter(_timed(t)))


@register("phase_profile", "SELECT bucket, phase, count(*) AS n, round(avg(ms), 6) AS mean, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM (SELECT CAST(vec_id % 4 AS VARCHAR) AS bucket, unnest(['beam', 'frontier']) AS phase, unnest([CAST(vec_id * 7 % 101 AS DOUBLE), coalesce(CASE WHEN vec_id % 6 > 0 THEN vec_id * 13 % 57 END, 0) / 2.0]) AS ms FROM embeddings) GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    rows = t.rows.select((v % 4).cast("string").alias("bucket"), (v * 7 % 101).cast("double").alias("beam"), (F.when(v % 6 > 0, v * 13 % 57) / 2.0).alias("frontier"))
    return _rounded(sweeps.phases(rows, "beam", "frontier"), "mean")


@register("percentiles_ranged", "SELECT event_type, share, round(value, 6) AS value FROM (SELECT event_type, unnest([0.5, 0.95, 0.99]) AS share, unnest(quantile_cont(value, [0.5, 0.95, 0.99])) AS value FROM events GROUP BY event_type)")
def _(t: Tables) -> DataFrame:
    return _rounded(evaluate.percentiles(t.table("events"), "value", [0.5, 0.95, 0.99], "event_type"), "value")


@register("memory_rollup", "SELECT run_id, component, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT vec_id % 8 AS run_id, 'c' || (label % 3) AS component, vec_id * 8 AS bytes FROM embeddings) GROUP BY GROUPING SETS ((run_id, component), (run_id))")
def _(t: Tables) -> DataFrame:
    return sweeps.memory(t.rows.select((F.col("vec_id") % 8).alias("run_id"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("component"), (F.col("vec_id") * 8).alias("bytes")))


@register("memory_peak", "SELECT dataset, coalesce(max(CAST(rss AS DOUBLE)) FILTER (WHERE pq_m IS NULL OR pq_m = 16), 0.0) AS peak FROM (SELECT 'd' || (vec_id % 6) AS dataset, vec_id * 31 % 997 AS rss, CASE WHEN vec_id % 6 = 5 THEN 8 WHEN vec_id % 4 = 0 THEN 16 WHEN vec_id % 4 = 1 THEN 32 END AS pq_m FROM embeddings) GROUP BY dataset")
def _(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    rows = t.rows.select(F.concat(F.lit("d"), (v % 6).cast("string")).alias("dataset"), (v * 31 % 997).alias("rss"), F.when(v % 6 == 5, 8).when(v % 4 == 0, 16).when(v % 4 == 1, 32).alias("pq_m"))
    return sweeps.peak(rows, "rss", "pq_m", 16)


@register("bucket_selectivity", "SELECT bucket, round(median(s), 9) AS selectivity FROM (SELECT vec_id % 5 AS bucket, (vec_id * 17 % 100) / 100.0 AS s FROM embeddings) GROUP BY bucket")
def _(t: Tables) -> DataFrame:
    rows = t.rows.select((F.col("vec_id") % 5).alias("bucket"), (F.col("vec_id") * 17 % 100 / 100.0).alias("selectivity"))
    return _rounded(sweeps.median_selectivity(rows), "selectivity")


@register("curve_anchors", "SELECT method, recall, latency_ms, measured FROM (SELECT vec_id % 4 AS method, (vec_id % 70) / 100.0 AS recall, vec_id / 1.0 AS latency_ms, TRUE AS measured FROM embeddings) UNION ALL SELECT method, recall, latency_ms, FALSE FROM (SELECT unnest([0, 1, 2, 9]) AS method, unnest([0.99, 0.5, 0.995, 0.3]) AS recall, unnest([50.0, 60.0, 70.0, 80.0]) AS latency_ms) a WHERE recall > coalesce((SELECT max((vec_id % 70) / 100.0) FROM embeddings WHERE vec_id % 4 = a.method), -1)")
def _(t: Tables) -> DataFrame:
    v = F.col("vec_id")
    curve = t.rows.select((v % 4).alias("method"), (v % 70 / 100.0).alias("recall"), (v / 1.0).alias("latency_ms"))
    anchors = t.spark.createDataFrame([(0, 0.99, 50.0), (1, 0.5, 60.0), (2, 0.995, 70.0), (9, 0.3, 80.0)], "method long, recall double, latency_ms double")
    return sweeps.with_anchors(curve, anchors)


@register("plan_grid", "SELECT a AS nlist, b AS nprobe FROM (SELECT unnest([16, 32, 64]) AS a), (SELECT unnest([1, 2, 4, 8]) AS b) WHERE NOT (a = 32 AND b = 4) UNION SELECT 128, 8")
def _(t: Tables) -> DataFrame:
    plan = evaluate.grid(t.spark, nlist=[16, 32, 64], nprobe=[1, 2, 4, 8])
    more, done = (t.spark.createDataFrame(rows, plan.schema) for rows in ([(128, 8), (16, 1)], [(32, 4)]))
    return sweeps.merged_plan(plan, more, done).select(F.col("nlist").cast("int").alias("nlist"), F.col("nprobe").cast("int").alias("nprobe"))


@register("runs_refreshed", "SELECT run_id, CASE WHEN run_id % 4 = 0 THEN 0.25 ELSE recall END AS recall, run_id % 4 <> 0 AS missing FROM runs")
def _(t: Tables) -> DataFrame:
    # Results are found by the parameters in their files' names.
    files = t.rows.select(F.concat(F.lit("/results/run_"), "vec_id", F.lit("_ef"), (F.col("vec_id") % 4 * 10), F.lit(".json")).alias("file"))
    named = sweeps.raw_parameters(files, r"run_(\d+)_ef(\d+)\.json", "run_id", "ef").where("ef = '0'")
    again = named.select(F.col("run_id").cast("long").alias("run_id"), F.lit(0.25).alias("recall"))
    return sweeps.refreshed(t.runs.select("run_id", "recall"), again, "run_id")


@register("runs_not_empty", "SELECT run_id FROM runs WHERE run_id % 6 <> 0")
def _(t: Tables) -> DataFrame:
    empty = lambda c, m: F.when(F.col("run_id") % m != 0, F.col(c)).alias(c)
    return evaluate.drop_empty(t.runs.select("run_id", empty("recall", 2), empty("qps", 3)), "recall", "qps").select("run_id")


@register("buckets_chosen", f"{_TIMED} SELECT DISTINCT bucket FROM timed WHERE bucket IN ('p0', 'p2', 'p4')")
def _(t: Tables) -> DataFrame:
    return evaluate.three_buckets(_timed(t), "bucket")


# Curves


def _points(t: Tables) -> DataFrame:
    return evaluate.frontier(t.runs.withColumn("g", F.col("run_id") % 2), ("g",))


@register("curve_fall")
def _(t: Tables) -> DataFrame:
    return curves.longest_fall(t.runs.withColumn("g", F.col("run_id") % 2), ("g",))


@register("curve_simplified")
def _(t: Tables) -> DataFrame:
    return curves.without_plateaus(curves.limited(curves.simplified(_points(t), 0.01, ("g",)), 7, ("g",)), by=("g",))


@register("curve_latency")
def _(t: Tables) -> DataFrame:
    return curves.smooth_latency_at(_points(t).withColumn("latency_ms", 1000 / F.col("qps")), [0.3, 0.5, 0.7, 0.9], ("g",))


# Change logs


@register("postings_inserted", f"SELECT cluster_id, vec_id FROM (SELECT vec_id, cluster_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS r FROM ({_NEAREST}) QUALIFY r <= 4) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT vec_id, cluster_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster_id) AS r FROM ({_NEAREST})) b JOIN means x ON x.cluster_id = a.cluster_id JOIN means y ON y.cluster_id = b.cluster_id WHERE b.vec_id = a.vec_id AND b.r < a.r AND {_dist('x.centroid', 'y.centroid')} < a.d)")
def _(t: Tables) -> DataFrame:
    return updates.postings_of(t.vectors, t.means().select("cluster_id", "centroid"), 4)


@register("postings_live", "SELECT cluster_id, vec_id FROM (SELECT label AS cluster_id, vec_id FROM embeddings WHERE vec_id % 9 <> 0) WHERE vec_id % 4 <> 1 UNION ALL SELECT 99, vec_id FROM embeddings WHERE vec_id % 4 = 1 AND vec_id % 9 <> 0")
def _(t: Tables) -> DataFrame:
    old = t.clustered.withColumn("seq", F.col("vec_id"))
    new = t.clustered.where("vec_id % 4 = 1").withColumns({"seq": F.col("vec_id") + 1_000_000, "cluster_id": F.lit(99)})
    rows = old.unionByName(new)
    log = rows.select("vec_id", "seq", F.lit("insert").alias("op")).unionByName(t.vectors.where("vec_id % 9 = 0").select("vec_id", (F.col("vec_id") + 2_000_000).alias("seq"), F.lit("delete").alias("op")))
    return updates.live_postings(rows, log).select("cluster_id", "vec_id")


@register("misplaced", f"SELECT vec_id, label AS cluster_id, nearest FROM embeddings JOIN (SELECT vec_id, arg_min(cluster_id, (round(d, 9), cluster_id)) AS nearest FROM ({_NEAREST}) GROUP BY vec_id) USING (vec_id) WHERE label <> nearest")
def _(t: Tables) -> DataFrame:
    return updates.misplaced(t.clustered, t.means())


@register("compacted")
def _(t: Tables) -> DataFrame:
    means, placed = updates.compact(t.clustered, t.means().select(F.col("cluster_id").cast("int").alias("cluster_id"), "centroid"), t.vectors.count() // 12, 5)
    return placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


_U = workload.uniform_sql("vec_id")


@register("steady_state", f""", steps AS (SELECT unnest([0, 1, 2]) AS step), u AS (SELECT vec_id, {_U} AS u FROM embeddings)
SELECT CAST(step AS INT) AS step, count(*) AS live FROM steps, u WHERE CASE WHEN u >= 0.1 THEN 0 ELSE least(floor(u / 0.1 * 2) + 1, 2) END <= step AND NOT (u >= 0.1 AND u < 0.2 AND least(floor((u - 0.1) / 0.1 * 2) + 1, 2) <= step) GROUP BY step""")
def _(t: Tables) -> DataFrame:
    trace = workload.update_trace(t.vectors, 2, 0.1)
    return updates.steady_state(trace, t.vectors, t.queries, t.means().select("cluster_id", "centroid"), 10, K).where("recall = 1").select("step", "live")


@register("knn_table_function", _ranked("SELECT * FROM pairs", 3))
def _(t: Tables) -> DataFrame:
    """kNN as a lateral join: for each query row its own ranked rows."""
    # The outer name is one that the inner rows don't have under any projection, or it would be resolved there.
    found = knn.unfiltered(t.queries, t.vectors, 3)
    near = found.where(F.col("query_id") == F.col("outer_id").outer()).select("query_id", "rank", "vec_id", "dist").orderBy("rank").limit(3)
    return _near(t.queries.select(F.col("query_id").alias("outer_id")).lateralJoin(near))


