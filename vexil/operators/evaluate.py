"""Evaluation of recorded results: recall, latency, buckets, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexil.lineage import cut


def cutoffs(truth: DataFrame) -> DataFrame:
    """query_id, cutoff: the largest true distance."""
    return truth.groupBy("query_id").agg(F.max("dist").alias("cutoff"))


def recall(queries: DataFrame, results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, hits, n_truth, recall, empty_truth: distinct results that are true. Without truth the recall is one, and marked."""
    hits = results.select("query_id", "vec_id").distinct().join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    joined = queries.select("query_id").join(sizes, "query_id", "left").join(hits, "query_id", "left").fillna(0, ["hits", "n_truth"])
    return joined.select("query_id", "hits", "n_truth", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.col("hits") / F.col("n_truth")).alias("recall"), (F.col("n_truth") == 0).alias("empty_truth"))


def recall_with_ties(queries: DataFrame, results: DataFrame, truth: DataFrame, slack: float = 1e-9) -> DataFrame:
    """As recall(), but any result no farther than the largest true distance counts; at most one."""
    cut = truth.groupBy("query_id").agg(F.max("dist").alias("cutoff"), F.count(F.lit(1)).alias("n_truth"))
    near = results.dropDuplicates(["query_id", "vec_id"]).join(cut, "query_id").where(F.col("dist") <= F.col("cutoff") + slack)
    hits = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    joined = queries.select("query_id").join(cut.drop("cutoff"), "query_id", "left").join(hits, "query_id", "left").fillna(0, ["hits", "n_truth"])
    return joined.select("query_id", "n_truth", F.when(F.col("n_truth") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("hits") / F.col("n_truth"))).alias("recall"))


def reciprocal_rank(results: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, rr: one over the rank of the first true result; 0 without one."""
    first = results.join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]).groupBy("query_id").agg(F.min("rank").alias("r"))
    return results.select("query_id").distinct().join(first, "query_id", "left").select("query_id", F.coalesce(1 / F.col("r"), F.lit(0.0)).alias("rr"))


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, least, most, median, p90, sd (of the population) and how many are one."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.9).alias("p90"), F.stddev_pop(v).alias("sd"), F.count_if(v >= 1).alias("n_perfect")]
    return df.groupBy(*by).agg(*aggs)


def latencies(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Milliseconds: mean, percentiles and the serial rate 1000 / mean."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean_ms"), *(F.percentile(v, p / 100).alias(f"p{p}_ms") for p in (50, 95, 99)), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), (1000 / F.avg(v)).alias("qps")]
    return df.groupBy(*by).agg(*aggs)


def percentiles(df: DataFrame, value: str, shares: list[float], *by: str) -> DataFrame:
    """by, share, value: exact percentiles with linear interpolation, of groups of any size. Distinct values are counted and ranked in ranges, so that
    no task holds a group; the tables that are windowed over have a row for each group and range."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    ranged = cut(counts.repartitionByRange(*keys, "__v").sortWithinPartitions(*keys, "__v").withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__p").agg(F.sum("__n").alias("__size"))
    line = Window.partitionBy(*keys).orderBy("__p")
    sizes = sizes.select(*keys, "__p", (F.sum("__size").over(line) - F.col("__size")).alias("__before"), F.sum("__size").over(Window.partitionBy(*keys)).alias("__all"))
    inside = Window.partitionBy(*keys, "__p").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("__upto", F.sum("__n").over(inside))
    same = [placed[c].eqNullSafe(sizes[c]) for c in [*keys, "__p"]]
    rows = placed.join(F.broadcast(sizes), same).select(*(placed[c] for c in keys), "__v", "__all", (F.col("__upto") - F.col("__n") + F.col("__before")).alias("__low"), (F.col("__upto") + F.col("__before")).alias("__high"))
    # The values at the two places around each share's.
    asked = F.explode(F.array(*map(F.lit, shares))).alias("share")
    rows = rows.select("*", asked).withColumn("__at", F.col("share") * (F.col("__all") - 1))
    holds = lambda place: (F.col("__low") <= place) & (place < F.col("__high"))
    found = rows.where(holds(F.floor("__at")) | holds(F.ceil("__at"))).groupBy(*keys, "share").agg(F.min("__v").alias("a"), F.max("__v").alias("b"), F.first("__at").alias("__at"))
    return found.select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("__at") - F.floor("__at"))).alias("value"))


def percentile_targets(df: DataFrame, value: str, targets: tuple[int, ...] = (1, 25, 50, 75, 99)) -> DataFrame:
    """target, value: exact percentiles with linear interpolation."""
    one = df.agg(F.percentile(value, F.array(*(F.lit(t / 100) for t in targets))).alias("v"))
    return one.select(F.posexplode("v").alias("k", "value")).select(F.element_at(F.array(*map(F.lit, targets)), F.col("k") + 1).alias("target"), "value")


def nearest_bucket(rows: DataFrame, value: str, targets: DataFrame) -> DataFrame:
    """Adds bucket: the target (target, value) nearest to the row's value; ties go to the smaller target."""
    t = targets.agg(F.array_sort(F.collect_list(F.struct("target", F.col("value").alias("v")))).alias("ts"))
    gaps = F.transform("ts", lambda x: F.struct(F.abs(x["v"] - F.col(value)).alias("gap"), x["target"].alias("target")))
    return rows.crossJoin(F.broadcast(t)).withColumn("bucket", F.array_min(gaps)["target"]).drop("ts")


def frontier(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The runs that no other beats: per recall (9 digits) the fastest, if faster than all with higher recall. runs: run_id, recall, qps."""
    r = F.round("recall", 9)
    best = runs.groupBy(*by, r.alias("recall")).agg(F.max(F.struct("qps", F.negate("run_id").alias("m"))).alias("b")).select(*by, "recall", "b.qps", F.negate("b.m").alias("run_id"))
    above = F.max("qps").over(Window.partitionBy(*by).orderBy(F.desc("recall")).rowsBetween(Window.unboundedPreceding, -1))
    return best.withColumn("above", above).where("above is null or qps > above").select(*by, "run_id", "recall", "qps")


def latency_at(points: DataFrame, target: float, by: tuple[str, ...] = ()) -> DataFrame:
    """latency_ms at a recall, log-linear between the two frontier points around it; no row outside their range. points: recall, latency_ms."""
    w = Window.partitionBy(*by).orderBy("recall")
    pairs = points.withColumns({"next_recall": F.lead("recall").over(w), "next_ms": F.lead("latency_ms").over(w)})
    exact = points.where(F.col("recall") == target).select(*by, F.col("latency_ms").cast("double").alias("latency_ms"))
    t = (target - F.col("recall")) / (F.col("next_recall") - F.col("recall"))
    between = pairs.where((F.col("recall") < target) & (F.col("next_recall") > target))
    return exact.unionByName(between.select(*by, F.exp(F.ln("latency_ms") + t * (F.ln("next_ms") - F.ln("latency_ms"))).alias("latency_ms")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace rows of old with the same key; columns of both are those of old."""
    rest = [c for c in old.columns if c != key]
    both = old.select(key, F.struct(*rest).alias("o")).join(new.select(key, F.struct(*rest).alias("n")), key, "full")
    return both.select(key, F.coalesce("n", "o").alias("r")).select(key, "r.*")


def drop_empty(runs: DataFrame, *values: str) -> DataFrame:
    return runs.dropna("all", subset=list(values))


def three_buckets(rows: DataFrame, bucket: str) -> DataFrame:
    """The first, middle and last of the distinct buckets, without any whose name holds 'overflow'; all of them, if they are three or fewer."""
    distinct = rows.select(bucket).distinct().where(~F.lower(F.col(bucket).cast("string")).contains("overflow"))
    ranked = distinct.withColumns({"r": F.row_number().over(Window.orderBy(bucket)), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.where((F.col("n") <= 3) | (F.col("r") == 1) | (F.col("r") == F.floor(F.col("n") / 2) + 1) | (F.col("r") == F.col("n"))).select(bucket)


def grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter values."""
    out = None
    for name, given in values.items():
        column = spark.createDataFrame([(v,) for v in given], [name])
        out = column if out is None else out.crossJoin(column)
    return out


def posting_histogram(postings: DataFrame, cluster: str, width: int) -> DataFrame:
    """low, n: how many clusters have sizes from low to low + width - 1."""
    sizes = postings.groupBy(cluster).agg(F.count(F.lit(1)).alias("s"))
    return sizes.groupBy((F.floor(F.col("s") / width) * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def bucket_of(value: Column, low: float, high: float, n: int) -> Column:
    """1 to n, of equal widths; values outside go to the ends."""
    return F.least(F.greatest(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(n)), F.lit(1)), F.lit(n))
