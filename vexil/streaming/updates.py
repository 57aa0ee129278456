"""Index maintenance from streams: change logs end in the same state as one batch of all changes.

A log has op ('insert', 'delete', 'grant', 'revoke'), seq (rising), vec_id and what the operation needs. Micro-batches append
to Parquet tables; the state is read from the log by last-one-wins, so a batch that is written twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexil.functions.distance import l2_squared
from vexil.lineage import cut
from vexil.operators.access import apply_log
from vexil.operators.cluster import assign, centroids, probe
from vexil.operators.evaluate import recall
from vexil.operators.knn import unfiltered

CHANGES = "op string, seq long, vec_id long, tid int, embedding array<float>"


def follow(changes: DataFrame, means: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends every change with the cluster of its vector; means (cluster_id, centroid) is sent to every task."""

    def put(batch: DataFrame, number: int) -> None:
        placed = batch.join(assign(batch.where("op = 'insert'"), means).groupBy("vec_id").agg(F.min("cluster_id").alias("cluster_id")), "vec_id", "left")
        placed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{CHANGES}, cluster_id int").parquet(path)


def live_vectors(log: DataFrame) -> DataFrame:
    """vec_id, embedding, cluster_id of vectors whose last insert or delete is an insert."""
    last = log.where("op in ('insert', 'delete')").groupBy("vec_id").agg(F.max_by(F.struct("op", "embedding", "cluster_id"), "seq").alias("l"))
    return last.where("l.op = 'insert'").select("vec_id", "l.embedding", "l.cluster_id")


def live_access(access: DataFrame, log: DataFrame) -> DataFrame:
    return apply_log(access, log.where("op in ('grant', 'revoke')"))


def postings_of(vectors: DataFrame, means: DataFrame, replicas: int = 8) -> DataFrame:
    """cluster_id, vec_id: each vector under its nearest heads, of which one counts only if no nearer head of the vector is closer to it than the vector is. Nothing is
    shuffled: the heads go to every task as one row, and the distances between them with it. means: cluster_id, centroid."""
    heads = means.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("heads"))
    near = F.slice(F.array_sort(F.transform("heads", lambda h: F.struct(l2_squared(F.col("embedding"), h["centroid"]).alias("dist"), h["cluster_id"].alias("cluster_id"), h["centroid"].alias("centroid")))), 1, replicas)
    rows = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(heads)).select("vec_id", near.alias("near"))
    shaded = lambda h: F.exists("near", lambda g: (F.struct(g["dist"], g["cluster_id"]) < F.struct(h["dist"], h["cluster_id"])) & (l2_squared(g["centroid"], h["centroid"]) < h["dist"]))
    return rows.select("vec_id", F.explode(F.filter("near", lambda h: ~shaded(h))).alias("h")).select("h.cluster_id", "vec_id")


def follow_postings(changes: DataFrame, means: DataFrame, path: str, checkpoint: str, replicas: int = 8) -> StreamingQuery:
    """Appends the postings of every inserted vector, with its seq as the version that tells them from those of the same vector before."""

    def put(batch: DataFrame, number: int) -> None:
        new = batch.where("op = 'insert'")
        postings_of(new, means, replicas).join(new.select("vec_id", "seq", "embedding"), "vec_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_postings(postings: DataFrame, log: DataFrame) -> DataFrame:
    """postings (vec_id, cluster_id, seq, embedding) of the last version of vectors that aren't deleted: stale copies are left out when read."""
    last = log.where("op in ('insert', 'delete')").groupBy("vec_id").agg(F.max(F.struct("seq", "op")).alias("l")).where("l.op = 'insert'").select("vec_id", F.col("l.seq").alias("seq"))
    return postings.join(last, ["vec_id", "seq"], "left_semi")


def compact(vectors: DataFrame, means: DataFrame, limit: int, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Clusters above the limit are split in two (around their nearest and their farthest member); those below `least` are given up; then
    means are taken anew and every vector goes to the nearest one, so none is left with a farther one than it could have.

    vectors: vec_id, embedding, cluster_id. Gives the new means and vectors."""
    sized = vectors.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    big = vectors.join(F.broadcast(sized.where(F.col("n") > limit)), "cluster_id").join(F.broadcast(means), "cluster_id")
    d = F.struct(l2_squared(F.col("embedding"), F.col("centroid")).alias("d"), "vec_id", "embedding")
    ends = cut(big.groupBy("cluster_id").agg(F.min(d).alias("a"), F.max(d).alias("b")))
    top = means.agg(F.max("cluster_id")).first()[0] or 0
    double = lambda c: F.transform(c, lambda x: x.cast("double")).alias("centroid")
    halves = ends.select("cluster_id", double("a.embedding")).unionByName(ends.select((F.col("cluster_id") + top + 1).cast("int").alias("cluster_id"), double("b.embedding")))
    small = means.join(sized, "cluster_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("cluster_id")
    rest = means.select("cluster_id", "centroid").join(ends.select("cluster_id"), "cluster_id", "left_anti").join(small, "cluster_id", "left_anti")
    seeds = cut(rest.unionByName(halves))
    if seeds.isEmpty():
        seeds = means.select("cluster_id", "centroid")
    once = vectors.select("vec_id", "embedding").join(assign(vectors, seeds).select("vec_id", "cluster_id"), "vec_id")
    moved = cut(centroids(once).select(F.col("cluster_id").cast("int").alias("cluster_id"), "centroid"))
    return moved, vectors.select("vec_id", "embedding").join(assign(vectors, moved).select("vec_id", "cluster_id"), "vec_id")


def misplaced(vectors: DataFrame, means: DataFrame) -> DataFrame:
    """vec_id, cluster_id, nearest: vectors whose cluster isn't the nearest one, as after a split beside them. vectors: vec_id, embedding, cluster_id."""
    best = assign(vectors, means).select("vec_id", F.col("cluster_id").alias("nearest"))
    return vectors.select("vec_id", "cluster_id").join(best, "vec_id").where("cluster_id <> nearest")


def snapshot(log: DataFrame, access: DataFrame, path: str) -> int:
    """Writes the state that a log leads to (vectors, access) and the last seq that it holds; gives that. A later state is the snapshot and the log after it."""
    last = log.agg(F.max("seq")).first()[0] or 0
    live_vectors(log).write.mode("overwrite").parquet(f"{path}/vectors")
    live_access(access, log).write.mode("overwrite").parquet(f"{path}/access")
    log.sparkSession.createDataFrame([(last,)], "seq long").coalesce(1).write.mode("overwrite").parquet(f"{path}/seq")
    return last


def restore(spark: SparkSession, path: str, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vectors and access: a snapshot's, and what the log says after it."""
    last = spark.read.parquet(f"{path}/seq").first()["seq"]
    kept, later = spark.read.parquet(f"{path}/vectors"), log.where(F.col("seq") > last)
    touched = later.where("op in ('insert', 'delete')").select("vec_id").distinct()
    vectors = kept.join(touched, "vec_id", "left_anti").unionByName(live_vectors(later).select(*kept.columns))
    return vectors, live_access(spark.read.parquet(f"{path}/access"), later)


def steady_state(trace: DataFrame, vectors: DataFrame, queries: DataFrame, means: DataFrame, nprobe: int, k: int) -> DataFrame:
    """step, live, recall: after each step's inserts and deletes, how much of the exact neighbours a search by clusters finds among the live vectors.

    trace: step, op, vec_id. Each query meets each step's live vectors once, so the work is that of a search a step."""
    steps = [r["step"] for r in trace.select("step").distinct().orderBy("step").collect()]  # one row a step
    span = trace.groupBy("vec_id").agg(F.min(F.when(F.col("op") == "insert", F.col("step"))).alias("born"), F.max(F.when(F.col("op") == "delete", F.col("step"))).alias("dead"))
    placed = cut(vectors.join(assign(vectors, means).select("vec_id", "cluster_id"), "vec_id").join(span, "vec_id"))
    out = None
    for step in steps:
        live = placed.where((F.col("born") <= step) & (F.col("dead").isNull() | (F.col("dead") > step))).select("vec_id", "embedding", "cluster_id")
        scored = recall(queries, probe(queries, live, means, nprobe, k), unfiltered(queries, live.select("vec_id", "embedding"), k))
        row = scored.agg(F.avg("recall").alias("recall")).crossJoin(live.agg(F.count(F.lit(1)).alias("live"))).select(F.lit(step).alias("step"), "live", "recall")
        out = row if out is None else out.unionByName(row)
    return out


def late_counts(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts of events (ts, event_type) by window and type; events later than delay are dropped, as in any watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
