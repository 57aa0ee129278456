"""Queries of synthetic labels, workloads, predicates and grants, and the SQL that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.catalog import K, Tables, _dist, _near, _ranked, register
from vexil.operators import access as acc
from vexil.operators import knn, workload
from vexil.plans import algebra, predicate

_U, _UT = workload.uniform_sql("vec_id"), workload.uniform_sql("vec_id", "tid")


def _chances(n: int, alpha: float, least: float, most: float) -> str:
    """tid, p of workload.zipf."""
    return f"SELECT CAST(i AS INT) AS tid, least(greatest(pow(i + 1, -{alpha}) * {most} / max(pow(i + 1, -{alpha})) OVER (), {least}), {most}) AS p FROM range(0, {n}) r(i)"


def _drawn(name: str, chances: str, seed: int = 42) -> str:
    """A CTE of workload.bernoulli."""
    u = workload.uniform_sql("vec_id", "tid", seed=seed)
    return f"""{name}_u AS (SELECT vec_id, tid, p, {u} AS u FROM embeddings, ({chances})),
{name} AS (SELECT vec_id, tid FROM {name}_u WHERE u < p UNION ALL SELECT vec_id, arg_min(tid, (round(-ln(u) / p, 9), tid)) FROM {name}_u WHERE vec_id NOT IN (SELECT vec_id FROM {name}_u WHERE u < p) GROUP BY vec_id)"""


# Labels


@register("labels_uniform", f"SELECT vec_id, CAST((row_number() OVER (ORDER BY {_U}, vec_id) - 1) % 20 AS INT) AS tid FROM embeddings")
def _(t: Tables) -> DataFrame:
    return workload.synthesise("uniform", t.vectors, 20)


@register("synthetic_labels", f", {_drawn('drawn', _chances(20, 1.0, 0.01, 0.5))} SELECT vec_id, tid FROM drawn")
def _(t: Tables) -> DataFrame:
    return workload.bernoulli(t.vectors, workload.zipf(t.spark, 20, 1.0, 0.01, 0.5))


@register("labels_skewed", f", {_drawn('drawn', _chances(30, 1.0, 0.0, 0.5))} SELECT tid, count(*) AS n FROM drawn GROUP BY tid")
def _(t: Tables) -> DataFrame:
    return workload.synthesise("skewed", t.vectors, 30).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@register("labels_filled", f""", chance AS ({_chances(8, 1.0, 0.05, 0.3)}), bare AS (SELECT DISTINCT vec_id FROM access WHERE vec_id % 5 = 0),
have AS (SELECT vec_id, CAST(vec_id % 8 AS INT) AS tid FROM embeddings WHERE vec_id % 5 <> 0),
lacks AS (SELECT tid, greatest(0.0, p * (SELECT count(*) FROM embeddings) - coalesce(n, 0)) AS lack FROM chance LEFT JOIN (SELECT tid, count(*) AS n FROM have GROUP BY tid) USING (tid)),
weights AS (SELECT tid, CASE WHEN sum(lack) OVER () < 1 THEN 1.0 ELSE lack END AS lack FROM lacks)
SELECT vec_id, tid FROM have UNION ALL SELECT vec_id, arg_min(tid, (-ln({workload.uniform_sql('vec_id', 'tid', seed=43)}) / lack, tid)) AS tid FROM bare, weights WHERE lack > 0 GROUP BY vec_id""")
def _(t: Tables) -> DataFrame:
    have = t.vectors.where("vec_id % 5 <> 0").select("vec_id", (F.col("vec_id") % 8).cast("int").alias("tid"))
    return workload.fill_by_deficit(t.vectors, have, workload.zipf(t.spark, 8, 1.0, 0.05, 0.3))


@register("labels_weighted", f"SELECT vec_id, tid FROM embeddings, ({_chances(20, 0.85, 0.0, 1.0)}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY ln(p) - ln(-ln({_UT})) DESC, tid) <= 3")
def _(t: Tables) -> DataFrame:
    return workload.weighted_labels(t.vectors, workload.zipf(t.spark, 20, 0.85, 0.0, 1.0), 3)


_FINE = _chances(3, 1.0, 0.1, 0.4)


@register("labels_hierarchical", f", {_drawn('top', _chances(5, 1.0, 0.1, 0.5))} SELECT vec_id, tid FROM top UNION SELECT vec_id, CAST(5 + tid * 3 + f AS INT) FROM top, (SELECT tid AS f, p FROM ({_FINE})) WHERE {workload.uniform_sql('vec_id', 'tid', 'f', seed=43)} < p")
def _(t: Tables) -> DataFrame:
    return workload.hierarchical(t.vectors, workload.zipf(t.spark, 5, 1.0, 0.1, 0.5), workload.zipf(t.spark, 3, 1.0, 0.1, 0.4), 3)


@register("labels_exact", f"SELECT vec_id, tid FROM embeddings, (SELECT CAST(i AS INT) AS tid, 5 * (i + 1) AS n FROM range(0, 10) r(i)) QUALIFY row_number() OVER (PARTITION BY tid ORDER BY {_UT}, vec_id) <= n")
def _(t: Tables) -> DataFrame:
    counts = t.spark.range(10).select(F.col("id").cast("int").alias("tid"), (5 * (F.col("id") + 1)).alias("n"))
    return workload.exact_labels(t.vectors, counts)


@register("labels_profile", f", counts AS (SELECT CAST(i AS INT) AS tid, CAST(round(CASE WHEN i < 3 THEN 0.01 WHEN i < 7 THEN 0.1 ELSE 0.4 END * (SELECT count(*) FROM embeddings)) AS BIGINT) AS n FROM range(0, 9) r(i)) SELECT tid, count(*) AS n FROM (SELECT vec_id, tid FROM embeddings, counts QUALIFY row_number() OVER (PARTITION BY tid ORDER BY {_UT}, vec_id) <= n) GROUP BY tid")
def _(t: Tables) -> DataFrame:
    counts = workload.profile_counts(t.spark, [(3, 0.01), (4, 0.1), (2, 0.4)], t.vectors.count())
    return workload.exact_labels(t.vectors, counts).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@register("labels_kmeans")
def _(t: Tables) -> DataFrame:
    return workload.synthesise("kmeans", t.vectors, 10).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


@register("access_repaired", "SELECT tid, count(DISTINCT vec_id) AS n, count(DISTINCT vec_id) / (SELECT count(*) FROM embeddings) AS selectivity, (SELECT count(*) FROM (SELECT DISTINCT vec_id, tid FROM access)) / (SELECT count(*) FROM embeddings) AS avg_labels_per_vec FROM access GROUP BY tid")
def _(t: Tables) -> DataFrame:
    fixed = acc.repair(t.vectors, t.grants.unionByName(t.grants.where("vec_id % 5 = 0")))
    return fixed["labels"].crossJoin(F.broadcast(fixed["metadata"].select("avg_labels_per_vec")))


# Data sets and queries


@register("split_train", f"SELECT vec_id, {_U} < 0.8 AS is_train FROM embeddings")
def _(t: Tables) -> DataFrame:
    return workload.split(t.vectors.select("vec_id"), "vec_id")


@register("permuted", f"SELECT vec_id, row_number() OVER (ORDER BY {_U}, vec_id) - 1 AS place FROM embeddings")
def _(t: Tables) -> DataFrame:
    return workload.permuted(t.vectors.select("vec_id"), "vec_id")


@register("small_set", f""", picked AS (SELECT vec_id FROM embeddings ORDER BY {_U}, vec_id LIMIT 200), own AS (SELECT DISTINCT vec_id, tid FROM access JOIN picked USING (vec_id)),
dense AS (SELECT tid, CAST(row_number() OVER (ORDER BY tid) - 1 AS INT) AS dense FROM (SELECT DISTINCT tid FROM own)),
asked AS (SELECT vec_id, arg_min(dense, ({workload.uniform_sql('vec_id', 'tid', seed=43)}, dense)) AS tid FROM (SELECT DISTINCT vec_id, tid FROM access) JOIN dense USING (tid) WHERE vec_id NOT IN (SELECT vec_id FROM picked) GROUP BY vec_id),
chosen AS (SELECT vec_id AS query_id, tid FROM asked ORDER BY {_U}, vec_id LIMIT 40) {_ranked(f"SELECT query_id, e.vec_id, {_dist('e.embedding', 'q.embedding')} AS dist FROM chosen c JOIN embeddings q ON q.vec_id = c.query_id JOIN dense d ON d.dense = c.tid JOIN own o ON o.tid = d.tid JOIN embeddings e ON e.vec_id = o.vec_id")}""")
def _(t: Tables) -> DataFrame:
    vectors, labels, queries = workload.small_set(t.vectors, t.grants, 200, 40)
    return _near(knn.single_label(queries, vectors, labels, K))


@register("overflow_queries", "SELECT vec_id, bucket FROM (SELECT vec_id, CAST(b AS VARCHAR) AS bucket, o FROM (SELECT vec_id, b, o, row_number() OVER (PARTITION BY b ORDER BY o, vec_id) AS r FROM (SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 2 END AS b, vec_id * 7919 % 1000 AS o FROM embeddings)) WHERE r <= 20) UNION ALL (SELECT vec_id, 'overflow' FROM (SELECT vec_id, o, row_number() OVER (PARTITION BY b ORDER BY o, vec_id) AS r FROM (SELECT vec_id, CASE WHEN label < 3 THEN 1 ELSE 2 END AS b, vec_id * 7919 % 1000 AS o FROM embeddings)) WHERE r > 20 ORDER BY o, vec_id LIMIT 10)")
def _(t: Tables) -> DataFrame:
    rows = t.rows.select("vec_id", F.when(F.col("label") < 3, 1).otherwise(2).alias("bucket"))
    return workload.stratified_filled(rows, "bucket", 20, 50, F.struct(F.col("vec_id") * 7919 % 1000, "vec_id"), "vec_id")


@register("update_trace", f", u AS (SELECT vec_id, {_U} AS u FROM embeddings) SELECT step, op, vec_id FROM (SELECT 0 AS step, 'insert' AS op, vec_id FROM u WHERE u >= 0.2 UNION ALL SELECT CAST(least(floor(u / 0.2 * 4) + 1, 4) AS INT), 'insert', vec_id FROM u WHERE u < 0.2 UNION ALL SELECT CAST(least(floor((u - 0.2) / 0.2 * 4) + 1, 4) AS INT), 'delete', vec_id FROM u WHERE u >= 0.2 AND u < 0.4)")
def _(t: Tables) -> DataFrame:
    return workload.update_trace(t.vectors, 4, 0.2)


# Predicates


def _some(n: int = 24) -> list[predicate.Node]:
    return workload.predicates([*range(10), *range(10, 17), *range(20, 23)], n, 7, frequent=[20, 21, 22])


_SOME = _some()
_SHOWN = [predicate.show(x, "prefix") for x in _SOME]


@register("pred_workload", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS formula, '{predicate.classify(n)}' AS kind, count(*) FILTER (WHERE {predicate.to_sql(n)}) / count(*) AS selectivity FROM lists" for s, n in zip(_SHOWN, _SOME)) + ")")
def _(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(s, predicate.classify(n)) for s, n in zip(_SHOWN, _SOME)], "formula string, kind string")
    shares = predicate.selectivity(t.lists(), dict(zip(_SHOWN, _SOME))).select(F.col("filter_id").alias("formula"), "selectivity")
    return kinds.join(shares, "formula")


@register("pred_representatives", "SELECT formula, kind, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY selectivity, formula) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS formula, '{predicate.classify(n)}' AS kind, count(*) FILTER (WHERE {predicate.to_sql(n)}) / count(*) AS selectivity FROM lists" for s, n in zip(_SHOWN, _SOME)) + ")) WHERE kind IN ('AND', 'AND_NOT') AND (rank = 1 OR rank = n) OR kind IN ('OR', 'NOT') AND rank = n // 2 + 1")
def _(t: Tables) -> DataFrame:
    kinds = t.spark.createDataFrame([(s, predicate.classify(n)) for s, n in zip(_SHOWN, _SOME)], "formula string, kind string")
    shares = predicate.selectivity(t.lists(), dict(zip(_SHOWN, _SOME))).select(F.col("filter_id").alias("formula"), "selectivity")
    return predicate.representatives(kinds.join(shares, "formula")).select("formula", "kind", F.col("rank").cast("int").alias("rank"))


_WORDY = "OR red AND NOT NOT seven NOT nothing"


@register("knn_pred_symbols", _ranked("SELECT query_id, vec_id, dist FROM pairs JOIN embeddings e USING (vec_id) WHERE e.label = 1 OR vec_id % 7 = 0"))
def _(t: Tables) -> DataFrame:
    node = algebra.Symbols({"red": 1, "seven": 10, "nothing": 77}).parse(_WORDY)
    node = algebra.simplify(node, {77: algebra.NONE})
    return _near(knn.under_predicate(t.queries, t.vectors.join(t.lists(), "vec_id"), predicate.to_column(node), K))


@register("pred_set_algebra", "SELECT vec_id FROM lists WHERE (list_contains(labels, 0) OR NOT list_contains(labels, 11)) AND NOT list_contains(labels, 21)")
def _(t: Tables) -> DataFrame:
    # Sets of a few labels are small here; the table form is set_operations.
    node = predicate.parse("AND OR 0 NOT 11 NOT 21")
    lists = t.lists()
    rows = lists.select(F.explode("labels").alias("tid"), "vec_id").where(F.col("tid").isin(*predicate.labels(node))).groupBy("tid").agg(F.collect_list("vec_id").alias("ids")).collect()
    met = algebra.evaluate(node, {r["tid"]: algebra.Known(frozenset(r["ids"])) for r in rows})
    ids = t.spark.createDataFrame([(i,) for i in sorted(met.ids)], "vec_id long")
    return lists.select("vec_id").join(ids, "vec_id", "left_anti" if met.but else "left_semi")


@register("set_operations", "SELECT 'either' AS op, vec_id FROM (SELECT vec_id FROM access WHERE tid = 10 UNION SELECT vec_id FROM access WHERE tid = 20) UNION ALL SELECT 'both', vec_id FROM (SELECT vec_id FROM access WHERE tid = 10 INTERSECT SELECT vec_id FROM access WHERE tid = 20) UNION ALL SELECT 'first', vec_id FROM (SELECT vec_id FROM access WHERE tid = 10 EXCEPT SELECT vec_id FROM access WHERE tid = 20)")
def _(t: Tables) -> DataFrame:
    a, b = (t.grants.where(f"tid = {x}").select("vec_id") for x in (10, 20))
    parts = [algebra.set_operation(a, b, how).select(F.lit(name).alias("op"), "vec_id") for name, how in (("either", "union"), ("both", "intersect"), ("first", "difference"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("knn_random_predicates", " UNION ALL ".join(f"SELECT '{s}' AS formula, query_id, rank, vec_id, dist FROM ({_ranked(f'SELECT query_id, vec_id, dist FROM pairs JOIN lists USING (vec_id) WHERE {predicate.to_sql(n)}', 3)})" for s, n in zip(_SHOWN[:6], _SOME[:6])))
def _(t: Tables) -> DataFrame:
    chosen = dict(zip(_SHOWN[:6], _SOME[:6]))
    names = t.spark.createDataFrame([(s,) for s in chosen], "formula string")
    asked = t.queries.crossJoin(F.broadcast(names)).select(F.struct("formula", "query_id").alias("query_id"), "q", F.col("formula").alias("filter_id"))
    found = knn.per_query_filter(asked, t.vectors, predicate.qualified(t.lists(), chosen), 3)
    return _near(found).select("query_id.formula", "query_id.query_id", "rank", "vec_id", "dist")
