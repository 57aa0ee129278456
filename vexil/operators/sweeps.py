"""Aggregates of recorded sweeps: by bucket, by filter and overall; phases; memory; merging of runs and their results.

Relations: timed(run_id, query_id, bucket, search_time_us, recall), a row a query; filtered(run_id, filter, query_id, search_time_us, recall), a
row a query and filter. A search time of zero or null counts as unknown: it takes part in no latency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _measures() -> list[Column]:
    ms = F.when(F.col("search_time_us") > 0, F.col("search_time_us") / 1000)
    return [F.count(F.lit(1)).alias("n"), F.avg(ms).alias("latency_ms"), F.avg("recall").alias("avg_recall"), F.min("recall").alias("min_recall"), F.try_divide(F.lit(1000.0), F.avg(ms)).alias("qps")]


def _rated(rows: DataFrame) -> DataFrame:
    return rows.where(~F.lower(F.coalesce("bucket", F.lit(""))).contains("overflow"))


def by_bucket(timed: DataFrame) -> DataFrame:
    """run_id, bucket and measures; buckets whose name holds 'overflow' are left out."""
    return _rated(timed).groupBy("run_id", "bucket").agg(*_measures())


def overall(timed: DataFrame) -> DataFrame:
    """run_id and measures over all queries, overflow included."""
    return timed.groupBy("run_id").agg(*_measures())


def by_filter(filtered: DataFrame) -> DataFrame:
    """run_id, filter and measures; a null filter stands for all of a run's, each query and filter counting alike."""
    return filtered.groupingSets([["run_id", "filter"], ["run_id"]], "run_id", "filter").agg(*_measures())


def phases(profiles: DataFrame, *names: str) -> DataFrame:
    """bucket, phase, n, mean, p50, p95 of the columns in names, in milliseconds; null counts as zero. Percentiles are approximate beyond 10,000 rows a group, so that no group is
    gathered."""
    rows = profiles.select("bucket", F.inline(F.array(*(F.struct(F.lit(x).alias("phase"), F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("ms")) for x in names))))
    return rows.groupBy("bucket", "phase").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), *(F.percentile_approx("ms", p / 100, 10_000).alias(f"p{p}") for p in (50, 95)))


def memory(parts: DataFrame) -> DataFrame:
    """run_id, component, bytes and, with a null component, the sum of a run's. parts: run_id, component, bytes."""
    return parts.groupingSets([["run_id", "component"], ["run_id"]], "run_id", "component").agg(F.sum("bytes").alias("bytes"))


def peak(runs: DataFrame, value: str, parameter: str | None = None, wanted: float | None = None) -> DataFrame:
    """dataset, peak: the largest value of each data set's runs, of those alone that have the wanted parameter or none at all; zero without any."""
    fits = F.lit(True) if parameter is None or wanted is None else F.col(parameter).isNull() | (F.col(parameter) == wanted)
    return runs.groupBy("dataset").agg(F.coalesce(F.max(F.when(fits, F.col(value).cast("double"))), F.lit(0.0)).alias("peak"))


def median_selectivity(queries: DataFrame) -> DataFrame:
    """bucket, selectivity: the median of each bucket's distinct queries."""
    return queries.groupBy("bucket").agg(F.percentile("selectivity", 0.5).alias("selectivity"))


def read_sweep(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files with sweep_results: runs (run_id, params, latency_ms, ...), buckets (run_id, bucket, count, ...) and filters (run_id, filter, ...).

    run_id is the file's name and the entry's place in it. Parameters are a map of strings; per_bucket and per_filter are objects named by bucket and filter."""
    entry = f"""params map<string, string>, latency_ms double, qps double, avg_recall double, min_recall double, build_time_s double, memory_bytes double, disk_bytes double,
        rss_peak_query_mb double, per_bucket map<string, struct<count: long, avg_latency_ms: double, avg_recall: double, qps: double>>,
        complex_predicate struct<n_filters: long, n_queries: long, avg_latency_ms: double, avg_recall: double, qps: double, per_filter: map<string, struct<avg_latency_ms: double, avg_recall: double, qps: double>>>"""
    fields = ", ".join(x.strip().replace(" ", ": ", 1) for x in _fields(entry))
    files = spark.read.schema(f"sweep_results array<struct<{fields}>>").option("multiLine", True).json(path)
    rows = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.posexplode("sweep_results").alias("place", "e"))
    rows = rows.select(F.concat_ws("#", "file", "place").alias("run_id"), "e.*")
    runs = rows.drop("per_bucket", "complex_predicate")
    buckets = rows.select("run_id", F.explode("per_bucket").alias("bucket", "m")).select("run_id", "bucket", "m.*")
    filters = rows.select("run_id", F.explode("complex_predicate.per_filter").alias("filter", "m")).select("run_id", "filter", "m.*")
    return runs, buckets, filters


def _fields(text: str) -> list[str]:
    """Fields of a schema text, parted at the commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def with_anchors(curve: DataFrame, anchors: DataFrame) -> DataFrame:
    """curve and the anchors whose recall lies above the highest of their curve; both: method, recall, latency_ms. Adds measured."""
    top = curve.groupBy("method").agg(F.max("recall").alias("top"))
    above = anchors.join(top, "method", "left").where("top is null or recall > top").drop("top")
    columns = ["method", "recall", "latency_ms"]
    return curve.select(*columns, F.lit(True).alias("measured")).unionByName(above.select(*columns, F.lit(False).alias("measured")))


def merged_plan(plan: DataFrame, supplement: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The distinct parameter rows of both, without those already done."""
    columns = plan.columns
    out = plan.unionByName(supplement.select(*columns)).distinct()
    return out if done is None else out.subtract(done.select(*columns))


def raw_parameters(files: DataFrame, pattern: str, *names: str) -> DataFrame:
    """file and the pattern's groups as columns (strings), of the files whose name matches as a whole. files: file."""
    base = F.regexp_extract("file", r"([^/]+)$", 1)
    rows = files.where(base.rlike(f"^(?:{pattern})$"))
    return rows.select("file", *(F.regexp_extract(base, f"^(?:{pattern})$", i).alias(n) for i, n in enumerate(names, 1)))


def refreshed(runs: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """runs, with the columns of `again` in place of theirs where it has the run; adds missing, for those that it has not."""
    columns = [c for c in again.columns if c != key and c in runs.columns]
    new = again.select(key, F.struct(*columns).alias("__new"))
    joined = runs.join(new, key, "left")
    replaced = {c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns({**replaced, "missing": F.col("__new").isNull()}).drop("__new")
