"""Synthetic labels, queries and predicates. Randomness is arithmetic on ids, the same at every size, on every cluster and in other SQL engines."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexil.plans.predicate import Label, Node, Op
from vexil.sources.formats import number_rows

#: A prime below 2**31 and the factors of two steps, so that no product exceeds 63 bits.
PRIME, FACTORS = 2147483647, (48271, 69621)


def uniform(*parts: Column | str, seed: int = 42) -> Column:
    """A number in (0, 1) that depends on integers alone; nulls count as zero."""
    numbers = [F.coalesce(F.pmod((F.col(p) if isinstance(p, str) else p).cast("long"), F.lit(PRIME).cast("long")), F.lit(0).cast("long")) for p in parts]
    a, b = FACTORS
    step = lambda h, x: (((h * a + x) % PRIME) * ((h * a + x) % PRIME) + ((h * a + x) % PRIME) * b + 12345) % PRIME
    h = F.aggregate(F.array(*numbers, F.lit(11).cast("long")), F.lit(seed % PRIME).cast("long"), step)
    return (h + 0.5) / float(PRIME)


def uniform_sql(*parts: str, seed: int = 42) -> str:
    """The same number in DuckDB."""
    a, b = FACTORS
    mixed = f"((h * {a} + x) % {PRIME})"
    listed = ", ".join(f"coalesce(CAST({p} AS BIGINT) % {PRIME}, 0)" for p in parts)
    return f"((list_reduce([CAST({seed % PRIME} AS BIGINT), {listed}, 11], lambda h, x: ({mixed} * {mixed} + {mixed} * {b} + 12345) % {PRIME}) + 0.5) / {float(PRIME)})"


def round_robin(vectors: DataFrame, n_labels: int, seed: int = 42) -> DataFrame:
    """One label each, in turn over the vectors in the order of a hash, so that labels differ by one vector at most."""
    placed = number_rows(vectors.select(F.col("vec_id").alias("id"), uniform("vec_id", seed=seed).alias("u")).distinct(), "u", "id")
    return placed.select(F.col("id").alias("vec_id"), (F.col("vec_id") % n_labels).cast("int").alias("tid"))


def zipf(spark: SparkSession, n_labels: int, alpha: float, least: float, most: float, mean_labels: float | None = None) -> DataFrame:
    """tid, p: probabilities that fall as rank ** -alpha, clipped, and scaled to a mean number of labels."""
    base = spark.range(n_labels).select(F.col("id").cast("int").alias("tid"), F.pow(F.col("id") + 1, F.lit(-alpha)).alias("w"))
    total = Window.partitionBy()
    scale = F.lit(most) / F.max("w").over(total) if mean_labels is None else F.lit(mean_labels) / F.sum("w").over(total)
    return base.select("tid", F.least(F.greatest(F.col("w") * scale, F.lit(least)), F.lit(most)).alias("p"))


def _each(vectors: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Every vector with the whole small table as one array, in order: nothing is shuffled."""
    one = table.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("every"))
    return vectors.select("vec_id").crossJoin(F.broadcast(one))


def bernoulli(vectors: DataFrame, chances: DataFrame, seed: int = 42) -> DataFrame:
    """vec_id, tid with probability p each; a vector without a label gets its likeliest by weighted draw."""
    rows = _each(vectors, chances, "tid", "p")
    drawn = F.transform("every", lambda x: F.struct((-F.ln(uniform("vec_id", x["tid"], seed=seed)) / x["p"]).alias("t"), x["tid"].alias("tid"), (uniform("vec_id", x["tid"], seed=seed) < x["p"]).alias("hit")))
    rows = rows.select("vec_id", drawn.alias("drawn"))
    hits = F.transform(F.filter("drawn", lambda x: x["hit"]), lambda x: x["tid"])
    return rows.select("vec_id", F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.array_min("drawn")["tid"]))).alias("tid"))


def fill_by_deficit(vectors: DataFrame, labels: DataFrame, chances: DataFrame, seed: int = 42) -> DataFrame:
    """labels (vec_id, tid), and for each vector without one a label drawn by weight from those that have fewer vectors than p asks for; if none lacks any,
    all count alike. chances: tid, p."""
    n = vectors.count()
    have = labels.groupBy("tid").agg(F.count(F.lit(1)).alias("n"))
    lacks = chances.join(have, "tid", "left").select("tid", F.greatest(F.lit(0.0), F.col("p") * n - F.coalesce("n", F.lit(0))).alias("lack"))
    total = lacks.agg(F.sum("lack").alias("total"))
    lacks = lacks.crossJoin(F.broadcast(total)).select("tid", F.when(F.col("total") < 1, 1.0).otherwise(F.col("lack")).alias("lack")).where("lack > 0")
    bare = vectors.join(labels.select("vec_id").distinct(), "vec_id", "left_anti")
    turn = F.transform("every", lambda x: F.struct((-F.ln(uniform("vec_id", x["tid"], seed=seed + 1)) / x["lack"]).alias("t"), x["tid"].alias("tid")))
    return labels.unionByName(_each(bare, lacks, "tid", "lack").select("vec_id", F.array_min(turn)["tid"].alias("tid")))


def weighted_labels(vectors: DataFrame, weights: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n distinct labels a vector, without replacement, by Gumbel keys. weights: tid, p."""
    key = lambda x: -(F.ln(x["p"]) - F.ln(-F.ln(uniform("vec_id", x["tid"], seed=seed))))
    ranked = F.array_sort(F.transform("every", lambda x: F.struct(key(x).alias("g"), x["tid"].alias("tid"))))
    return _each(vectors, weights, "tid", "p").select("vec_id", F.explode(F.slice(ranked, 1, n)).alias("x")).select("vec_id", "x.tid")


def hierarchical(vectors: DataFrame, coarse: DataFrame, fine: DataFrame, per: int, seed: int = 42) -> DataFrame:
    """Coarse labels, and for each of them fine ones of its own: label coarse * per + fine + the number of coarse labels."""
    top = bernoulli(vectors, coarse, seed)
    n = coarse.count()
    below = top.withColumnRenamed("tid", "c").crossJoin(F.broadcast(fine.withColumnRenamed("tid", "f"))).where(uniform("vec_id", "c", "f", seed=seed + 1) < F.col("p"))
    return top.unionByName(below.select("vec_id", (n + F.col("c") * per + F.col("f")).cast("int").alias("tid"))).distinct()


def synthesise(method: str, vectors: DataFrame, n_labels: int, seed: int = 42, alpha: float = 1.0, least: float = 0.01, most: float = 0.5, replicas: int = 3) -> DataFrame:
    """vec_id, tid by the method's name: uniform, zipf, skewed (one tier, from half of all vectors down), hierarchical (sqrt(n_labels) coarse ones) or kmeans."""
    spark = vectors.sparkSession
    if method == "uniform":
        return round_robin(vectors, n_labels, seed)
    if method in ("zipf", "skewed"):
        chances = zipf(spark, n_labels, alpha, least if method == "zipf" else 0.0, most)
        return bernoulli(vectors, chances, seed)
    if method == "hierarchical":
        coarse = max(1, round(n_labels**0.5))
        per = max(1, (n_labels - coarse) // coarse)
        return hierarchical(vectors, zipf(spark, coarse, alpha, least, most), zipf(spark, per, alpha, least, most), per, seed)
    if method == "kmeans":
        from vexil.operators.cluster import assign, kmeans

        means, _ = kmeans(vectors, n_labels, 5)
        return assign(vectors, means, replicas).select("vec_id", F.col("cluster_id").alias("tid"))
    raise ValueError(f"unknown method {method!r}")


def scaled_counts(weights: DataFrame, total: int) -> DataFrame:
    """tid, n: whole numbers in proportion to p that add up to total, by largest remainder."""
    exact = weights.withColumn("x", F.col("p") / F.sum("p").over(Window.partitionBy()) * total).withColumn("low", F.floor("x"))
    left = F.lit(total) - F.sum("low").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("x") - F.col("low"), 9)), "tid"))
    return exact.withColumns({"left": left, "place": place}).select("tid", (F.col("low") + (F.col("place") <= F.col("left")).cast("long")).alias("n"))


def profile_counts(spark: SparkSession, tiers: list[tuple[int, float]], n: int) -> DataFrame:
    """tid, n: tiers are (labels, share of the vectors of each), from the rarest on, so that given quantiles of selectivity come out."""
    shares = [share for labels, share in tiers for _ in range(labels)]
    return spark.createDataFrame([(i, round(s * n)) for i, s in enumerate(shares)], "tid int, n long")


def exact_labels(vectors: DataFrame, counts: DataFrame, seed: int = 42) -> DataFrame:
    """Every label on exactly n distinct vectors: the n with the smallest hashes for it (all, if there are fewer)."""
    most = counts.agg(F.max("n")).first()[0] or 0
    pairs = vectors.select("vec_id").crossJoin(F.broadcast(counts)).withColumn("u", uniform("vec_id", "tid", seed=seed))
    # The literal bound lets every partition cut before the shuffle.
    ranked = pairs.withColumn("r", F.row_number().over(Window.partitionBy("tid").orderBy("u", "vec_id"))).where(F.col("r") <= int(most))
    return ranked.where("r <= n").select("vec_id", "tid")


def split(rows: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds is_train."""
    return rows.withColumn("is_train", uniform(key, seed=seed) < share)


def permuted(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds place: the row's number, from 0, in an order set by a hash."""
    return number_rows(rows.withColumn("__u", uniform(key, seed=seed)), "__u", key, name="place").drop("__u")


def small_set(vectors: DataFrame, access: DataFrame, n: int, n_queries: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A small data set: n vectors by hash, the labels of theirs numbered densely from 0, and n_queries (query_id, q, tid) of the rest, each with one of its own
    labels that the small set knows."""
    order = (uniform("vec_id", seed=seed), F.col("vec_id"))
    picked = vectors.orderBy(*order).limit(n)
    rest = vectors.join(picked.select("vec_id"), "vec_id", "left_anti")
    own = access.select("vec_id", "tid").distinct().join(picked.select("vec_id"), "vec_id", "left_semi")
    dense = own.select("tid").distinct().withColumn("dense", (F.row_number().over(Window.orderBy("tid")) - 1).cast("int"))
    labels = own.join(F.broadcast(dense), "tid").select("vec_id", F.col("dense").alias("tid"))
    chosen = F.min(F.struct(uniform("vec_id", "tid", seed=seed + 1).alias("u"), "dense")).alias("c")
    asked = rest.join(access.select("vec_id", "tid").distinct(), "vec_id").join(F.broadcast(dense), "tid").groupBy("vec_id", "embedding").agg(chosen)
    queries = asked.orderBy(*order).limit(n_queries).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("c.dense").alias("tid"))
    return picked, labels, queries


def stratified(rows: DataFrame, bucket: str, per: int, order: Column) -> DataFrame:
    """Up to `per` rows of each bucket, by order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("__r") <= per).drop("__r")


def stratified_filled(rows: DataFrame, bucket: str, per: int, n: int, order: Column, key: str) -> DataFrame:
    """n rows: up to `per` of each bucket, and if these are fewer, others by the same order, with the bucket 'overflow'. Buckets become strings."""
    first = stratified(rows, bucket, per, order)
    rest = rows.join(first.select(key), key, "left_anti")
    short = max(0, n - first.count())
    filled = rest.orderBy(order).limit(short).withColumn(bucket, F.lit("overflow"))
    return first.withColumn(bucket, F.col(bucket).cast("string")).unionByName(filled).orderBy(F.col(bucket) == "overflow", bucket, order).limit(n)


def proportional(rows: DataFrame, bucket: str, n: int, order: Column) -> DataFrame:
    """About n rows, of each bucket in proportion, at least one."""
    sized = rows.withColumns({"__c": F.count(F.lit(1)).over(Window.partitionBy(bucket)), "__r": F.row_number().over(Window.partitionBy(bucket).orderBy(order))})
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("__n")))
    return sized.crossJoin(total).where(F.col("__r") <= F.greatest(F.lit(1), F.floor(n * F.col("__c") / F.col("__n")))).drop("__c", "__r", "__n")


def predicates(tids: list[int], n: int, seed: int = 42, frequent: list[int] | None = None) -> list[Node]:
    """n distinct predicates of the kinds NOT, AND, OR, AND-NOT and OR of three (all that there are, if fewer). frequent: labels that half of the ANDs and AND-NOTs
    take their first operand from, as two rare labels seldom meet."""
    rng, out = random.Random(seed), {}
    for _ in range(50 * n):
        a, b, c = (Label(x) for x in rng.sample(tids, 3))
        common = Label(rng.choice(frequent)) if frequent and rng.random() < 0.5 else a
        both = common if common != b else a
        node = rng.choice([Op("NOT", (a,)), Op("AND", (both, b)), Op("OR", (a, b)), Op("AND", (both, Op("NOT", (b,)))), Op("OR", (a, Op("OR", (b, c))))])
        out[node] = None
        if len(out) == n:
            break
    return list(out)


def update_trace(vectors: DataFrame, steps: int, share: float, seed: int = 42) -> DataFrame:
    """step, op, vec_id: from the first 1 - share of the vectors (by hash), each step deletes and inserts a `share`/steps part, so that the live number stays.
    A vector is inserted once at most and deleted once at most, not before it was there."""
    u = uniform("vec_id", seed=seed)
    placed = vectors.select("vec_id", u.alias("u"))
    base = placed.where(F.col("u") >= share).select(F.lit(0).alias("step"), F.lit("insert").alias("op"), "vec_id")
    at = F.least(F.floor(F.col("u") / share * steps) + 1, F.lit(steps)).cast("int").alias("step")
    coming = placed.where(F.col("u") < share).select(at, F.lit("insert").alias("op"), "vec_id")
    going = placed.where((F.col("u") >= share) & (F.col("u") < 2 * share))
    going = going.select(F.least(F.floor((F.col("u") - share) / share * steps) + 1, F.lit(steps)).cast("int").alias("step"), F.lit("delete").alias("op"), "vec_id")
    return base.unionByName(coming).unionByName(going)
