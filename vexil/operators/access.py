"""Access grants: (vec_id, tid) pairs and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_grants(access: DataFrame) -> DataFrame:
    return access.select("vec_id", "tid").distinct()


def label_lists(vectors: DataFrame, access: DataFrame) -> DataFrame:
    """vec_id, labels (sorted, distinct) of every vector; vectors without grants have an empty list."""
    lists = access.groupBy("vec_id").agg(F.array_sort(F.collect_set("tid")).alias("labels"))
    return vectors.select("vec_id").distinct().join(lists, "vec_id", "left").select("vec_id", F.coalesce("labels", F.expr("cast(array() as array<int>)")).alias("labels"))


def inverted_sizes(access: DataFrame) -> DataFrame:
    return distinct_grants(access).groupBy("tid").agg(F.count(F.lit(1)).alias("n"))


def inverted_lists(access: DataFrame) -> DataFrame:
    """tid, vec_ids (sorted). For small labels; large ones are better joined than gathered."""
    return access.groupBy("tid").agg(F.array_sort(F.collect_set("vec_id")).alias("vec_ids"))


def bitmaps(access: DataFrame) -> DataFrame:
    """tid, bucket, bitmap: the ids of a label as bitmaps of fixed size."""
    return access.groupBy("tid", F.bitmap_bucket_number("vec_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("vec_id")).alias("bitmap"))


def selectivity(vectors: DataFrame, access: DataFrame) -> DataFrame:
    """tid, n, selectivity (share of all vectors)."""
    total = vectors.agg(F.count(F.lit(1)).alias("total"))
    return inverted_sizes(access).join(F.broadcast(total)).select("tid", "n", (F.col("n") / F.col("total")).alias("selectivity"))


def revoke(access: DataFrame, revoked: DataFrame) -> DataFrame:
    return distinct_grants(access).join(revoked.select("vec_id", "tid").distinct(), ["vec_id", "tid"], "left_anti")


def apply_log(access: DataFrame, log: DataFrame) -> DataFrame:
    """log: vec_id, tid, op ('grant' or 'revoke'), seq. The last entry of a pair decides."""
    last = log.groupBy("vec_id", "tid").agg(F.max_by("op", "seq").alias("op"))
    joined = distinct_grants(access).withColumn("held", F.lit(True)).join(last, ["vec_id", "tid"], "full")
    return joined.where((F.col("op") == "grant") | (F.col("op").isNull() & F.col("held"))).select("vec_id", "tid")


def dense_ids(access: DataFrame) -> DataFrame:
    """tid, dense_tid from 0 in the order of tid: a table of labels."""
    return access.select("tid").distinct().withColumn("dense_tid", F.row_number().over(Window.orderBy("tid")) - 1)


def allocate(known: DataFrame, tids: DataFrame, reserved: list[int] | None = None) -> DataFrame:
    """tid, number of all of tids: those of known (tid, number) stay; new ones, in order, get the smallest numbers that are neither used nor reserved."""
    new = tids.select("tid").distinct().join(known.select("tid"), "tid", "left_anti")
    n_new, n_known = new.count(), known.count()
    spark = tids.sparkSession
    used = known.select("number").unionByName(spark.createDataFrame([(int(x),) for x in reserved or []], "number long")).distinct()
    # Among so many numbers enough are free.
    free = spark.range(n_new + n_known + len(reserved or [])).select(F.col("id").alias("number")).join(used, "number", "left_anti")
    ranked = new.withColumn("r", F.row_number().over(Window.orderBy("tid")))
    given = ranked.join(free.withColumn("r", F.row_number().over(Window.orderBy("number"))), "r").select("tid", "number")
    return known.select("tid", F.col("number").cast("long").alias("number")).unionByName(given)


def repair(vectors: DataFrame, access: DataFrame) -> dict[str, DataFrame]:
    """What follows from grants once repeated ones are counted once: access, lists (vec_id, labels), labels (tid, n, selectivity) and one row of metadata."""
    once = distinct_grants(access)
    shares = selectivity(vectors, once)
    metadata = vectors.agg(F.count(F.lit(1)).alias("train_size")).crossJoin(once.agg(F.countDistinct("tid").alias("n_labels"), F.count(F.lit(1)).alias("n_grants")))
    metadata = metadata.withColumn("avg_labels_per_vec", F.try_divide("n_grants", "train_size"))
    return {"access": once, "lists": label_lists(vectors, once), "labels": shares, "metadata": metadata}


def latest(versions: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """versions: vec_id, version, embedding. The newest of each vector, without those that were deleted at or after it."""
    now = versions.groupBy("vec_id").agg(F.max_by(F.struct("version", "embedding"), "version").alias("v")).select("vec_id", "v.*")
    if tombstones is None:
        return now
    dead = tombstones.groupBy("vec_id").agg(F.max("version").alias("dead"))
    return now.join(dead, "vec_id", "left").where("dead is null or dead < version").drop("dead")


def unknown_grants(vectors: DataFrame, access: DataFrame) -> DataFrame:
    """Grants of vectors that don't exist."""
    return access.join(vectors.select("vec_id"), "vec_id", "left_anti")


def short_lists(access: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """vec_id, tid, level: the shallowest level of paths (vec_id, level, node) at which the pair's node has at most `most` grants of tid."""
    at = distinct_grants(access).join(paths, "vec_id")
    sized = at.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("node", "level", "tid")))
    deepest = sized.groupBy("vec_id", "tid").agg(F.min(F.when(F.col("n") <= most, F.col("level"))).alias("fits"), F.max("level").alias("last"))
    return deepest.select("vec_id", "tid", F.coalesce("fits", "last").alias("level"))
