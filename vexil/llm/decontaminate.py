"""Benchmark decontamination: spaced-seed hashing, in DataFrame operations alone.

Words are lowered runs of letters and digits. Fixed masks take some words of a run of up to eight and ignore the others;
the hashes of all runs of the test items are joined with those of all runs of the documents. A hit gives an alignment of item
and document, which is then verified: some window of WINDOW aligned words (of the whole item, if that is shorter) must hold at
least SIMILAR equal words. The masks hit every such window: all placings of the allowed replaced words were tried (see
tests). Items of five to seven words, of which one may be replaced, have masks of fewer places, which documents are read by only if there are
such items. Items below SHORTEST words, the size of a shingle, are matched by no document.

Defined cases: null and empty texts have no words; a null doc_id or item_id is an id like others; rows that share a
doc_id count as one document, items that share an item_id as one item of which any text matches; repeated rows change nothing;
other columns are not read by leaks(), and all stay in clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm.shared import cut, release

#: The places that each mask reads, for items from LONG words on and for shorter ones.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
SHORT_MASKS = ((0, 1, 2), (0, 1, 3))
WINDOW, SIMILAR = 13, 0.8
SHORTEST, LONG = 5, 8
#: A text's words are taken in runs of so many, that overlap by the longest mask: no array grows with the text's length.
_RUN = 4096
#: So many rows of a few numbers may be sent to every task (some 30 MB); more are joined by a shuffle.
SENT_ROWS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """df, to be sent to every task only if its rows, counted, are few."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def words(text: str = "text") -> Column:
    """Hashes of a text's words."""
    found = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(hashed: DataFrame, key: str, masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """key, pos, seed of every place of every mask in h (the words' hashes)."""
    reach = 1 + max(map(max, masks))
    runs = F.expr(f"transform(sequence(0, greatest(size(h) - 1, 0), {_RUN}), s -> struct(s as s, slice(h, s + 1, {_RUN + reach - 1}) as r))")
    parts = hashed.select(F.col(key).alias("key"), F.inline(runs))
    # A row for each place with the words from there on, so that all hashing is compiled code; no words are null.
    ahead = F.arrays_zip(*(F.slice("r", k + 1, _RUN).alias(f"w{k}") for k in range(reach)))
    rows = parts.select("key", "s", F.posexplode(ahead).alias("p", "w")).where(F.col("w.w0").isNotNull())
    each = [F.when(F.col(f"w.w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col(f"w.w{i}") for i in mask))) for k, mask in enumerate(masks)]
    out = rows.select("key", (F.col("s") + F.col("p")).alias("pos"), F.explode(F.array(*each)).alias("seed")).where("seed is not null")
    return out.withColumnRenamed("key", key)


def _hits(hashed: DataFrame, test: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """doc_id, item, shift of all places that a mask tells of."""
    marks = seeds(test, "item", masks).select("seed", "item", F.col("pos").alias("item_pos")).distinct()
    found = seeds(hashed, "doc_id", masks).join(_bounded(cut(marks)), "seed")
    return found.select("doc_id", "item", (F.col("pos") - F.col("item_pos")).alias("shift"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, window (words), matched (most equal words in a window), shift (smallest distance of a matching alignment's starts), of all pairs that match."""
    release(docs.sparkSession)
    test = items.select("item_id", words().alias("h")).distinct().where(F.size("h") >= SHORTEST).withColumn("item", F.xxhash64("item_id", "h"))
    test = cut(test)
    hashed = docs.select("doc_id", words().alias("h"))
    long, short = test.where(F.size("h") >= LONG), test.where(F.size("h") < LONG)
    found = _hits(hashed, long, MASKS)
    if not short.isEmpty():
        found = found.unionByName(_hits(hashed, short, SHORT_MASKS))
    hits = cut(found.distinct())
    hit_docs = hits.select(F.col("doc_id").alias("hit_id")).distinct()
    texts = docs.select("doc_id", "text").join(_bounded(hit_docs), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    texts = texts.select(F.col("doc_id").alias("hit_id"), words().alias("d")).distinct()
    pairs = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("hit_id"))).join(_bounded(test), "item")
    pairs = pairs.withColumns({"lo": F.greatest(F.lit(0), -F.col("shift")), "hi": F.least(F.size("h"), F.size("d") - F.col("shift")), "window": F.least(F.lit(WINDOW), F.size("h"))})
    pairs = pairs.where("hi - lo >= window")
    # Running counts of equal words; a window's is the difference of two.
    equal = F.expr("transform(sequence(lo, hi - 1), i -> if(d[i + shift] = h[i], 1, 0))")
    pairs = pairs.withColumn("equal", equal)
    best = F.expr("array_max(transform(sequence(0, size(equal) - window), s -> aggregate(slice(equal, s + 1, window), 0, (a, x) -> a + x)))")
    pairs = pairs.withColumn("matched", best)
    least = F.ceil(F.col("window") * F.lit(int(SIMILAR * 100)) / 100)
    return pairs.where(F.col("matched") >= least).groupBy("doc_id", "item_id").agg(F.max("window").alias("window"), F.max("matched").alias("matched"), F.min("shift").alias("shift"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that match no item."""
    bad = leaks(docs, items).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
