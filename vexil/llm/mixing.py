"""Mixing sources to target weights: Pfair scheduling.

Every source's documents, in an order set by a hash of their ids, are cut into blocks. Block i (from 0) of a source with weight
w is released at slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the released block with the
earliest deadline, so that after any number of slots every source has had its share up to less than one block. Weights are
taken as the exact fractions that they are, over the whole run: one task deals all blocks, holding one block of each
source at a time. A source that runs out leaves its slots empty: all documents stay, and up to `horizon`, where the
first source ends, the mix is exact (in_mix).

Defined cases: a null source is a source of its own; null ids and repeated rows get places of their own, in any order
among themselves, and are spread over tasks however many there are; an empty table gives no row; texts aren't read; sources without a weight, or
weights that aren't positive, raise ValueError; sources without documents count for nothing; other columns stay, whatever their names, but for those of
the added names, which are replaced.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexil.llm.shared import cut

BLOCK = 64
PERIOD = 1000
#: More sources than this can't be scheduled on the driver.
MOST_SOURCES = 100_000
#: A schedule of so many blocks may be sent to every task; a longer one is joined by a shuffle.
SENT_BLOCKS = 1_000_000
_ROWS = 50_000  # wished for in a bucket of the order, and in a batch of the schedule
_LEAST_ROWS = 256
_NAMES, _TYPES = ("__k", "__block", "__r", "__d", "__slot", "__ends"), (pa.int32(), *[pa.int64()] * 4, pa.bool_())


def ratios(weights: dict[str | None, float]) -> tuple[list[str | None], list[int], int]:
    """Names in order (null first), and whole numbers in the exact ratio of their weights, with their sum."""
    if any(not w > 0 or math.isinf(w) for w in weights.values()):
        raise ValueError("weights must be positive")
    names = sorted(weights, key=lambda x: (x is not None, x))
    parts = [Fraction(weights[x]) for x in names]
    scale = math.lcm(*(x.denominator for x in parts))
    whole = [x.numerator * (scale // x.denominator) for x in parts]
    return names, whole, sum(whole)


def schedule(parts: list[int], total: int, blocks: list[int]) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(source, block, release, deadline, slot, whether it is the source's last) of all blocks, by earliest deadline among the released; ties go to the first source.

    Sources that have ended only leave slots to the others, so no deadline is missed without them.
    """
    waiting = [(0, k, 0) for k in range(len(parts))]
    ready: list[tuple[int, int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // parts[k]), k, i, release))
        deadline, k, i, release = heapq.heappop(ready)
        yield k, i, release, deadline, slot, i + 1 == blocks[k]
        if i + 1 < blocks[k]:
            heapq.heappush(waiting, ((i + 1) * total // parts[k], k, i + 1))
        slot += 1


def _plan(spark: SparkSession, parts: list[int], total: int, blocks: list[int]) -> DataFrame:
    """The schedule as rows; dealt in one task, as each slot depends on those before."""
    shared = spark.sparkContext.broadcast((parts, total, blocks))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            dealt = schedule(*shared.value)
            while rows := list(itertools.islice(dealt, _ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], list(_NAMES))

    return spark.range(1, numPartitions=1).mapInArrow(deal, "__k int, __block long, __r long, __d long, __slot long, __ends boolean")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """Adds block, release, deadline, slot, place (within the block) and in_mix to all rows of docs (doc_id, source, ...); read in the order (slot, place).

    weights: by source; by default the square root of each source's documents. Columns of the added names are replaced.
    period: not needed any more, as no weight is rounded; kept for callers.
    """
    spark = docs.sparkSession
    added = ("block", "release", "deadline", "slot", "place", "in_mix")
    docs = docs.drop(*added)
    counted = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(counted) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r["source"]: r["n"] for r in counted}
    if not counts:
        return docs.select("*", *(F.lit(None).cast("int" if x == "place" else "boolean" if x == "in_mix" else "long").alias(x) for x in added))
    if weights is None:
        weights = {x: math.sqrt(n) for x, n in counts.items()}
    if missing := [x for x in counts if x not in weights]:
        raise ValueError(f"no weight for {missing[:5]}")
    names, parts, total = ratios({x: weights[x] for x in counts})
    blocks = [-(-counts[x] // block) for x in names]
    if any(n * total // p >= 1 << 63 for n, p in zip(blocks, parts, strict=True)):
        raise ValueError("weights are too far apart")
    plan = cut(_plan(spark, parts, total, blocks))
    # The slot after that of the first last block of a source.
    horizon = plan.where("__ends").agg(F.min("__slot").alias("slot")).first()["slot"] + 1
    plan = plan.drop("__ends")
    name = lambda x: "-" if x is None else f"+{x}"
    # A source's rows are ranked in buckets of about `wish` at most, of which a large source has more.
    wish = min(_ROWS, max(_LEAST_ROWS, sum(counts.values()) // 1024))
    digits = [max(1, math.ceil(math.log(max(1, counts[x] / wish), 16))) for x in names]
    numbers = spark.createDataFrame([(name(x), k, digits[k]) for k, x in enumerate(names)], "s string, __k int, digits int")
    # A source's order is that of the md5 of the ids; buckets of its first digits are ranked apart and then put in line. All columns travel as
    # one, so that no name of theirs can clash.
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")))
    source = F.coalesce(F.concat(F.lit("+"), docs["source"]), F.lit("-"))
    dealt = docs.select(row, source.alias("s"), key.alias("key")).join(F.broadcast(numbers), "s")
    dealt = dealt.select("row", "s", "__k", "key", F.substring("key", F.lit(1), F.col("digits")).alias("bucket"))
    dealt, by = _split(dealt, wish), ["s", "bucket", "part"]
    sizes = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("s").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("key", "row.doc_id")) - 1
    placed = dealt.withColumn("rank", rank).join(before, by).select("row", "__k", (F.col("rank") + F.col("before")).alias("at"))
    placed = placed.select("row", "__k", F.floor(F.col("at") / block).alias("__block"), (F.col("at") % block).cast("int").alias("place"))
    out = placed.join(F.broadcast(plan) if sum(blocks) <= SENT_BLOCKS else plan, ["__k", "__block"])
    last = [F.col("__block").alias("block"), F.col("__r").alias("release"), F.col("__d").alias("deadline"), F.col("__slot").alias("slot"), "place", (F.col("__slot") < horizon).alias("in_mix")]
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *last)


def _split(dealt: DataFrame, wish: int) -> DataFrame:
    """Adds part: rows of one key are in one bucket, and a bucket that has many more than `wish` falls into parts, by the number of the row. There are at
    most as many such buckets as rows / (4 * wish)."""
    hot = dealt.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * wish)
    hot = cut(hot.select("s", "bucket", F.ceil(F.col("n") / wish).alias("parts")))
    if hot.isEmpty():
        return dealt.withColumn("part", F.lit(0).cast("long"))
    number = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
    # Kept, as a row that is read again must have the same part.
    return cut(dealt.join(F.broadcast(hot), ["s", "bucket"], "left").withColumn("part", F.coalesce(number, F.lit(0).cast("long"))).drop("parts"))
