"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A text's shingles are its runs of five words (a text of one to four words is one shingle); a shingle weighs its count in
the text times 1 + log10(min(N / df, 1 / COMMON)), with df from all documents. So only shingles in more than COMMON of
all documents need their df, and there are at most (mean shingles per document) / COMMON of these, however large N is: a
pass that counts hash buckets finds the few buckets that can hold them, a second pass counts their shingles exactly.

Equal texts are one class from the start. Texts that share a band of samples, and are of a like weight, are candidates, but the pairs of a bucket are not
all made. Each bucket has a lead, the member that meets most texts, and a lead's group is all members of its buckets; a lead that is
similar to the lead of a larger group with it in gives its group to that one, if that one keeps its own. First the
lead is compared with its whole group. What that leaves are pairs (x, y) of a group with x not linked to the lead L; a small
group makes them all, a large one only those that share a difference from the lead. With d the weighted L1 distance and
c = (1 - t) / (1 + t), texts are similar if d(x, y) <= c * (W(x) + W(y)), and d(x, y) is d(x, L) + d(y, L) less twice the weight of
the differences from L that x and y share. As d(x, L) > c * (W(x) + W(L)), a similar pair shares more than
(d(y, L) - c * (W(y) - W(L))) / 2 of y's differences. So y is entered under its differences, the rarest first, but for a tail of
that weight, and x looks under its own but for a tail of d(x, L) - c * (1 + 1 / t) * W(x), which a similar pair shares at least as d is a
metric and W(y) <= W(x) / t. Where y's shingles but for a tail of less than t * W(y) cost less, y is entered
under these; x looks under its own but for such a tail too. All texts sort names alike, so the first name that a pair shares is in neither
tail, and all that the pair shares is in what either text has from there on. So a pair is made under a name only if both have as much left there as a similar pair has to share:
(d(x, L) - c * W(x) + d(y, L) - c * W(y)) / 2 of differences, t / (1 + t) * (W(x) + W(y)) of shingles. These filters are exact: they leave out no similar pair of a group. Texts in large buckets that have too many shingles of
their own to be similar to any other text of such buckets leave these first, and keep their small ones. The classes are the connected components of all links. With 12
bands of 3 samples a pair of similarity 0.8 meets with probability 0.9998.

Defined cases: null and empty texts, or texts without a word, are each a class of their own; a null doc_id is too;
rows that share a doc_id but not the text are documents of their own, each with the class of its own text; rows that share both have one class and
stay or go together; ties go to the smallest doc_id, then to the smallest hash of the text; columns beside doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexil.llm.components import components
from vexil.llm.ragged import doc_of, hash_words, mix, text_blocks
from vexil.llm.shared import cut, release, small_batches, tasks_for

SHINGLE = 5
#: Shingles in a smaller share of all documents weigh alike: there are too many of them to send their counts to every task.
COMMON = 0.001
BANDS, ROWS = 12, 3
#: Groups of more members compare only texts that share a difference from the lead.
SMALL_GROUP = 16
#: Names that more members have are of a higher level, and the later a text is entered under them.
LEVELS = tuple(1 << k for k in range(15))
_COSTS = np.array([0, *(2 << k for k in range(15))])
#: Buckets of more members are first rid of texts that can have no partner.
LARGE = 64
MOST_CELL_BITS = 24
_BUCKET_BITS = 20
_SLICES = 64  # rows in which a task sends its bucket counts
_IDS = np.uint64((1 << 48) - 1)


def _body() -> Column:
    return F.xxhash64("text").alias("body")


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles by row: ids, counts, the rows' offsets; and a 64-bit hash of each row's words (0: no words)."""
    h, off = hash_words(text)
    doc, n = doc_of(off), len(off) - 1
    sizes = np.diff(off)
    place = np.arange(len(h)) - off[:-1][doc]
    run = np.zeros(len(h), np.uint64)
    for k in range(size):
        there = np.flatnonzero(place + k < sizes[doc])
        run[there] = mix(run[there] * np.uint64(0x9E6C63D0876A9A47) + h[there + k])
    keep = (place + size <= sizes[doc]) | (place == 0)
    salted = mix(h + mix(place.astype(np.uint64)))
    whole = np.zeros(n, np.uint64)
    full = np.flatnonzero(sizes > 0)
    if len(full):
        whole[full] = mix(np.add.reduceat(salted, off[:-1][full]) + sizes[full].astype(np.uint64)) | np.uint64(1)
    key, count = np.unique(doc[keep].astype(np.uint64) << np.uint64(48) | run[keep] >> np.uint64(16), return_counts=True)
    ends = np.searchsorted((key >> np.uint64(48)).astype(np.int64), np.arange(n + 1))
    return key & _IDS, count, ends, whole


def _blocks(text: pa.Array) -> Iterator[tuple[int, int]]:
    for i, j in text_blocks(text, 1 << 18):
        for k in range(i, j, 1 << 15):  # a row's number has 16 bits in shingles()
            yield k, min(j, k + (1 << 15))


class Weights:
    """Weights of shingles, from the common ones' document counts."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, n: int):
        order = np.argsort(ids)
        self.ids, self.idf = ids[order], 1 + np.log10(np.maximum(n / np.maximum(counts[order], 1), 1))
        self.top = 1 + math.log10(min(max(n, 1), 1 / COMMON))

    def __call__(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        idf = np.full(len(ids), self.top)
        if len(self.ids):
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            same = self.ids[at] == ids
            idf[same] = np.minimum(self.idf[at[same]], self.top)
        return idf * count


def common_shingles(docs: DataFrame) -> Weights:
    """Exact document counts of the shingles in more than COMMON of all rows of docs (text)."""
    small_batches(docs.sparkSession)
    n = docs.count()
    least = COMMON * n
    size = 1 << _BUCKET_BITS
    step = size // _SLICES

    def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for i, j in _blocks(b["text"]):
                ids, _, _, _ = shingles(b["text"].slice(i, j - i))
                total += np.bincount((ids >> np.uint64(48 - _BUCKET_BITS)).astype(np.int64), minlength=size)
        blobs = [pa.compress(total[i : i + step].astype(np.uint32).tobytes(), codec="zstd", asbytes=True) for i in range(0, size, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int64)
        for x in pdf["blob"]:
            total += np.frombuffer(pa.decompress(x, 4 * step, codec="zstd", asbytes=True), np.uint32)
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(total > least).tobytes()]})

    texts = docs.select("text")
    rows = texts.mapInArrow(bucket_counts, "slice int, blob binary").groupBy("slice").applyInPandas(add, "slice int, bits binary").collect()  # 128 KB
    flags = np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(rows, key=lambda r: r["slice"])), np.uint8)
    if not flags.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), n)
    shared = docs.sparkSession.sparkContext.broadcast(flags)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            found = [np.zeros(0, np.uint64)]
            for i, j in _blocks(b["text"]):
                ids = shingles(b["text"].slice(i, j - i))[0]
                found.append(ids[hot[(ids >> np.uint64(48 - _BUCKET_BITS)).astype(np.int64)]])
            ids, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(count)], ["id", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([b[x].to_numpy().tobytes()], pa.binary()) for x in ("id", "n")], ["id", "n"])

    counts = texts.mapInArrow(exact, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    packed = counts.mapInArrow(pack, "id binary, n binary").collect()  # 16 bytes for each common shingle
    ids, found = (np.frombuffer(b"".join(bytes(r[x]) for r in packed), np.int64) for x in ("id", "n"))
    return Weights(ids.astype(np.uint64), found, n)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """65536 draws of Gamma(2, 1), shuffled by a fixed seed: for r, and the logs of others for c."""
    rng = np.random.default_rng(20)
    r, c = rng.gamma(2.0, 1.0, (2, 1 << 16))
    return r.astype(np.float32), np.log(c).astype(np.float32)


def samples(ids: np.ndarray, weight: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples of each row: hashes of the drawn (shingle, step); rows without shingles get 0."""
    r_of, c_of = _tables()
    n = len(ends) - 1
    out = np.zeros((k, n), np.uint64)
    full = np.flatnonzero(np.diff(ends) > 0)
    if not len(full):
        return out
    begins, sizes = ends[:-1][full], np.diff(ends)[full]
    log_w = np.log(weight).astype(np.float32)
    low = np.uint64(0xFFFF)
    for s in range(k):
        z = mix(ids + np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        r = r_of[(z & low).astype(np.int64)]
        t = np.floor(log_w / r + (z >> np.uint64(32) & low).astype(np.float32) / np.float32(65536))
        beta = (z >> np.uint64(32) & low).astype(np.float32) / np.float32(65536)
        log_a = c_of[(z >> np.uint64(16) & low).astype(np.int64)] - r * (t - beta + np.float32(1))
        least = np.minimum.reduceat(log_a, begins)
        hit = np.flatnonzero(log_a == np.repeat(least, sizes))
        at = hit[np.searchsorted(hit, begins)]
        out[s, full] = mix(ids[at] * np.uint64(0xD1342543DE82EF95) + t[at].astype(np.int64).astype(np.uint64))
    return out


def signatures(docs: DataFrame, weights: Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, body (hash of the text), whole (hash of all words; null: no words), weight (of all shingles), keys (one hash for each band)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _blocks(b["text"]):
                ids, count, ends, whole = shingles(b["text"].slice(i, j - i))
                w = shared.value(ids, count)
                drawn = samples(ids, w, ends, bands * rows)
                keys = np.zeros((bands, j - i), np.uint64)
                for s in range(bands * rows):
                    keys[s // rows] = mix(keys[s // rows] * np.uint64(0x9E6C63D0876A9A47) + drawn[s] + np.uint64(s))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.T.reshape(-1).astype(np.int64)), bands).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["body"].slice(i, j - i), pa.array(whole.astype(np.int64), mask=whole == 0), pa.array(np.bincount(doc_of(ends), w, j - i).astype(np.float64)), lists], ["doc_id", "body", "whole", "weight", "keys"])

    return docs.select("doc_id", _body(), "text").mapInArrow(run, "doc_id long, body long, whole long, weight double, keys array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) with text_a and text_b, from texts (doc_id, text). A member that meets many others is split over tasks."""
    left, right = (texts.toDF(x, f"text_{x}") for x in ("a", "b"))
    return pairs.join(left, "a").join(right, "b")


def _weighed(batch: pa.RecordBatch, weights: Weights) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Each row's number, and the shingles and weights of its two texts."""
    for i, j in _blocks(batch["text_b"]):
        a, b = (shingles(batch[x].slice(i, j - i)) for x in ("text_a", "text_b"))
        wa, wb = (weights(x[0], x[1]) for x in (a, b))
        for k in range(j - i):
            p, q = slice(a[2][k], a[2][k + 1]), slice(b[2][k], b[2][k + 1])
            yield i + k, (a[0][p], wa[p]), (b[0][q], wb[q])


def _jaccard(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The rows of pairs (a, b) whose texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for k, (a, wa), (b, wb) in _weighed(batch, shared.value):
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                same = b[at] == a
                both = np.minimum(wa[same], wb[at[same]]).sum()
                kept[k] = both >= (threshold - 1e-9) * (wa.sum() + wb.sum() - both)
            rows = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows["a"], rows["b"]], ["a", "b"])

    return _with_texts(pairs, texts).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def names(lead: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, that differ by salt, of a text's differences from its lead, these ones' weights, and hashes of its shingles."""
    (l_ids, l_w), (ids, w) = lead, own
    every, at = np.unique(np.concatenate([l_ids, ids]), return_inverse=True)
    delta = np.bincount(at, np.concatenate([-l_w, w]), len(every))
    seed = mix(np.array([salt], np.int64).view(np.uint64))
    name = [mix(every ^ mix(seed + np.uint64(k))) for k in range(3)]
    more, less = np.flatnonzero(delta > 0), np.flatnonzero(delta < 0)
    return np.concatenate([name[0][more], name[1][less]]), np.abs(delta[np.concatenate([more, less])]), name[2][at[len(l_ids) :]]


def entries(lead: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray], threshold: float, salt: int, level) -> tuple[np.ndarray, ...]:
    """The names that a text is entered under, and those that it looks under if it isn't similar to the lead. level: how many members have a name, as a class; 0: one.

    Then for both lists, each name's room and part: room is the weight of the name and all later ones of its kind, and two texts that are similar
    have at least the sum of their parts as room at the first name of a kind that they share.

    Of two similar texts of which one isn't similar to the lead, that one looks under a name that the other is entered under,
    whatever the levels are, as long as a name that both have isn't on level 0: all texts put names in one order (level, name), the first name that
    two similar texts share can't be in either one's tail, as all that they share would then be in it.
    """
    diff, diff_w, words = names(lead, own, salt)
    total, l_total, far = own[1].sum(), lead[1].sum(), diff_w.sum()
    threshold -= 1e-9  # as _jaccard has it
    slack, c = 1e-12 * (total + l_total), (1 - threshold) / (1 + threshold)
    # A similar text shares more than this if the one here is entered (so a tail of just that goes too), and at least this if it looks.
    entered, looking = (far - c * (total - l_total)) / 2 + slack, far - c * (1 + 1 / threshold) * total - slack
    best, least, looked = None, None, []
    parts = (far - c * total) / 2 - slack, threshold / (1 + threshold) * total - slack
    for name, w, tail, other_tail, part in ((diff, diff_w, entered, looking, parts[0]), (words, own[1], threshold * total - slack, threshold * total - slack, parts[1])):
        at = level(name)
        order = np.lexsort((name, at))  # the rarest first: few others have them
        left = np.cumsum(w[order][::-1])[::-1]
        few, more = order[left > tail], order[left > other_tail]
        cost = np.take(_COSTS, at[few]).sum()
        lists = [(name[some][at[some] > 0], left[: len(some)][at[some] > 0]) for some in (few, more)]
        (few, few_left), (more, more_left) = lists
        if best is None or cost < least:
            best, least = (few, few_left, np.full(len(few), part)), cost
        looked.append((more, more_left, np.full(len(more), part)))
    looked = [np.concatenate(x) for x in zip(*looked, strict=True)]
    return best[0], looked[0], *best[1:], *looked[1:]


def _cells(rows: DataFrame, bits: int, cells, above: tuple[int, ...]) -> np.ndarray:
    """For each hash cell, how many of the counts in above (15 at most, each below 65535) it exceeds: four bits a cell. cells(batch) gives arrays of cells."""
    step = (1 << bits) // _SLICES
    most = max(above) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint16)
        for b in batches:
            for at in cells(b):
                at, n = np.unique(at, return_counts=True)
                total[at] = np.minimum(total[at] + n, most)
        blobs = [pa.compress(total[i : i + step].tobytes(), codec="zstd", asbytes=True) for i in range(0, 1 << bits, step)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["slice", "blob"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(step, np.int32)
        for x in pdf["blob"]:
            total = np.minimum(total + np.frombuffer(pa.decompress(x, 2 * step, codec="zstd", asbytes=True), np.uint16), most)
        levels = sum((total > n).astype(np.uint8) for n in above).reshape(-1, 2)
        return pd.DataFrame({"slice": [key[0]], "bits": [(levels[:, 0] | levels[:, 1] << 4).astype(np.uint8).tobytes()]})

    out = np.zeros((_SLICES, step // 2), np.uint8)
    for r in rows.mapInArrow(run, "slice int, blob binary").groupBy("slice").applyInPandas(add, "slice int, bits binary").collect():  # 8 MB at most
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _level(packed: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return packed[cell >> 1] >> (cell & 1).astype(np.uint8) * np.uint8(4) & np.uint8(15)


def sharing_pairs(group: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """a, b: all similar pairs of different classes of each lead's members of which one at least is marked apart, and few others. group: lead, rep, apart, class."""
    spark = texts.sparkSession
    weigh = spark.sparkContext.broadcast(weights)
    pairs = group.select(F.col("lead").alias("a"), F.col("rep").alias("b"), "apart", "class")
    pairs = cut(_with_texts(pairs, texts).select("a", "b", "apart", "class", "text_a", "text_b"))
    n = pairs.agg(F.sum(F.length("text_a") + F.length("text_b")).alias("n")).first()["n"] or 0
    bits = min(MOST_CELL_BITS, max(_BUCKET_BITS, int(n).bit_length() + 1))
    shift = np.uint64(64 - bits)

    def cell(name: np.ndarray) -> np.ndarray:
        return (name >> shift).astype(np.int64)

    def all_names(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        leads = batch["a"].to_numpy()
        for k, lead, own in _weighed(batch, weigh.value):
            diff, _, words = names(lead, own, leads[k])
            yield cell(np.concatenate([diff, words]))

    often = spark.sparkContext.broadcast(_cells(pairs, bits, all_names, LEVELS))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads, apart = batch["a"].to_numpy(), batch["apart"].to_numpy(zero_copy_only=False)
            total, lists = [], {c: [] for c in columns}
            for k, lead, own in _weighed(batch, weigh.value):
                few, full, *rest = entries(lead, own, threshold, leads[k], lambda name: _level(often.value, cell(name)))
                total.append(own[1].sum())
                for c, x in zip(columns, (few.view(np.int64), *rest[:2], full.view(np.int64), *rest[2:]), strict=True):
                    lists[c].append(x if apart[k] or c.startswith("entered") else x[:0])
            arrays = [pa.array(lists[c], pa.list_(kind)) for c, kind in columns.items()]
            yield pa.RecordBatch.from_arrays([batch["b"], batch["class"], pa.array(total, pa.float64()), *arrays], ["rep", "class", "weight", *columns])

    columns = {f"{side}{c}": kind for side in ("entered", "looked") for c, kind in (("", pa.int64()), ("_room", pa.float64()), ("_part", pa.float64()))}
    lists = ", ".join(f"{side} array<long>, {side}_room array<double>, {side}_part array<double>" for side in ("entered", "looked"))
    rows = cut(pairs.mapInArrow(differ, f"rep long, class long, weight double, {lists}"))

    def values_of(batch: pa.RecordBatch) -> np.ndarray:
        return cell(batch["key"].flatten().to_numpy().view(np.uint64))

    looked, entered = (rows.select("rep", "class", "weight", *(F.col(f"{side}{c}").alias(name) for c, name in (("", "key"), ("_room", "room"), ("_part", "part")))) for side in ("looked", "entered"))
    known = spark.sparkContext.broadcast(_cells(entered, bits, lambda batch: [values_of(batch)], (0,)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array(_level(known.value, values_of(batch)) > 0)
            row = pc.list_parent_indices(batch["key"]).filter(hit)
            yield pa.RecordBatch.from_arrays([*(batch[c].flatten().filter(hit) for c in ("key", "room", "part")), *(batch[c].take(row) for c in ("rep", "class", "weight"))], ["key", "room", "part", "rep", "class", "weight"])

    x, y = (t.mapInArrow(spread, "key long, room double, part double, rep long, class long, weight double") for t in (looked, entered))
    x, y = different_lists(x, y)
    y = y.select("key", *(F.col(c).alias(f"other_{c}") for c in ("room", "part", "class", "weight")), F.col("rep").alias("other"))
    close = F.least("weight", "other_weight") >= (threshold - 1e-9) * F.greatest("weight", "other_weight")
    close &= (F.col("rep") != F.col("other")) & (F.col("class") != F.col("other_class"))
    close &= F.least("room", "other_room") >= F.col("part") + F.col("other_part")
    return x.join(y, "key").where(close).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def different_lists(x: DataFrame, y: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x and y (key, rep, class, ...) under those keys alone that can make a pair of two classes, and of keys that have the same rows on both sides, but for their room, as the shingles of one
    passage have, under one: each makes the same pairs. Its room, if there is one, is the largest of theirs."""
    sides = cut(x.withColumn("looks", F.lit(True)).unionByName(y.withColumn("looks", F.lit(False))))
    own = [c for c in x.columns if c not in ("key", "room")]
    texts = [F.xxhash64(F.lit(seed), *own) for seed in (1, 2)]
    lists = [f(F.when(F.col("looks") == side, h)).alias(f"{name}{side}") for side in (True, False) for name, f, h in (("n", F.count, F.lit(1)), ("a", F.bit_xor, texts[0]), ("b", F.bit_xor, texts[1]))]
    known = sides.groupBy("key").agg(*lists, F.min("class").alias("least"), F.max("class").alias("most")).where("nTrue > 0 and nFalse > 0 and least <> most").drop("least", "most")
    same = [f"{name}{side}" for side in (True, False) for name in "nab"]
    known = cut(known.groupBy(*same).agg(F.min("key").alias("first"), F.collect_list("key").alias("keys")).select("first", F.explode("keys").alias("key")))
    sides = sides.join(known, "key").groupBy(F.col("first").alias("key"), *own, "looks").agg(F.max("room" if "room" in x.columns else F.lit(0)).alias("room"))
    sides = cut(sides.select(*x.columns, "looks"))
    return sides.where("looks").drop("looks"), sides.where("not looks").drop("looks")


def linked_leads(groups: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """groups (lead, rep), where a lead that is similar to the lead of a larger group that holds it, and that keeps its own group, gives its group to that one."""
    size = groups.count()
    sizes = cut(groups.groupBy("lead").agg(F.count(F.lit(1)).alias("n")), size)
    inner = groups.join(sizes.select(F.col("lead").alias("rep"), F.col("n").alias("own")), "rep").join(sizes, "lead").where("n > own")
    inner = cut(inner.select(F.col("lead").alias("a"), F.col("rep").alias("b"), "n"), size)
    if inner.isEmpty():
        return groups
    similar = _jaccard(inner.select("a", "b"), texts, weights, threshold).join(inner, ["a", "b"])
    similar = cut(similar, size)
    # A lead that gives its group away is in none of its own name any more: others would lose sight of their lead there.
    given = similar.select(F.col("b").alias("a")).distinct()
    similar = similar.join(given, "a", "left_anti")
    taken = cut(similar.groupBy("b").agg(F.min(F.struct(F.negate("n").alias("n"), "a")).alias("by")).select(F.col("b").alias("lead"), F.col("by.a").alias("by")), size)
    return cut(groups.join(taken, "lead", "left").select(F.coalesce("by", "lead").alias("lead"), "rep").where("rep <> lead").coalesce(tasks_for(size)).distinct(), size)


def without_partners(docs: DataFrame, ids: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Those of ids (doc_id) that no other of them can be similar to: too much of their weight is in shingles that none of the others has.

    Counts go into a table of hash cells, of a size set by the ids up to 2**MOST_CELL_BITS; a cell that one text alone fills holds a shingle
    of its own. Texts that meet in a cell by chance are kept, so a full table prunes less but never wrongly.
    """
    bits = min(MOST_CELL_BITS, max(_BUCKET_BITS, (ids.count() * 1024).bit_length()))
    shift = np.uint64(48 - bits)
    texts = cut(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))

    def cells(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for i, j in _blocks(b["text"]):
            yield (shingles(b["text"].slice(i, j - i))[0] >> shift).astype(np.int64)

    levels = _cells(texts.select("text"), bits, cells, (1,))
    spark = docs.sparkSession
    shared, weigh = spark.sparkContext.broadcast(levels), spark.sparkContext.broadcast(weights)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _blocks(b["text"]):
                part, count, ends, _ = shingles(b["text"].slice(i, j - i))
                w = weigh.value(part, count)
                row = doc_of(ends)
                mine = np.bincount(row, np.where(_level(shared.value, (part >> shift).astype(np.int64)) == 0, w, 0), j - i)
                full = np.bincount(row, w, j - i)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i).filter(pa.array(mine > (1 - threshold + 1e-6) * full))], ["doc_id"])

    return texts.mapInArrow(alone, "doc_id long").distinct()


def _named(rows: DataFrame, shared_ids: DataFrame | None) -> DataFrame:
    """rows (doc_id, body, ...) with node, the name that a text goes by: its doc_id, if no other text has that."""
    if shared_ids is None:
        return rows.withColumn("node", F.col("doc_id"))
    several = shared_ids.select("doc_id", F.lit(True).alias("several"))
    return rows.join(several, "doc_id", "left").withColumn("node", F.when(F.col("several"), F.xxhash64("doc_id", "body")).otherwise(F.col("doc_id"))).drop("several")


def classified(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, body, class_id, n_links and class (a name that no two classes share; null for rows that are classes of their own)."""
    release(docs.sparkSession)
    weights = common_shingles(docs)
    signed = cut(signatures(docs, weights))
    real = signed.where("doc_id is not null and whole is not null")
    shared_ids = real.groupBy("doc_id").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a <> b").select("doc_id")
    shared_ids = cut(shared_ids)
    shared_ids = None if shared_ids.isEmpty() else shared_ids
    named = _named(real, shared_ids)
    docs = docs.select("doc_id", _body(), "text").where("doc_id is not null")
    docs = _named(docs, shared_ids).select(F.col("node").alias("doc_id"), "text")
    # Equal words: one representative. Keys tell apart any texts whose hash is equal by chance.
    most = BANDS * signed.count()
    reps = cut(named.groupBy("whole", F.xxhash64("keys").alias("sig")).agg(F.min_by("node", F.struct("doc_id", "body")).alias("rep"), F.first("keys").alias("keys"), F.first("weight").alias("weight")), most)
    members = reps.select("rep", "weight", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "rep", "weight")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = cut(members.join(shared, "bucket").distinct(), most)
    n = open_.count()
    open_ = open_.coalesce(tasks_for(n))
    large = cut(open_.where(F.col("n") > LARGE).select(F.col("rep").alias("doc_id")).distinct(), n)
    if not large.isEmpty():
        alone = cut(without_partners(docs, large, weights, threshold), n)
        # They were only held against texts of large buckets: their small ones stay.
        alone = alone.select(F.col("doc_id").alias("rep"), F.lit(True).alias("alone"))
        open_ = open_.join(alone, "rep", "left").where((F.col("n") <= LARGE) | F.col("alone").isNull()).coalesce(tasks_for(n))
    open_ = open_.select("bucket", "rep", "weight")
    # Similar texts are of equal or neighbouring classes of weight, so each bucket falls into parts whose members differ less from their lead.
    size_class = F.floor(F.log("weight") / -math.log(threshold - 1e-6)).cast("long")
    open_ = open_.withColumn("size", F.explode(F.array(size_class, size_class + 1))).select(F.xxhash64("bucket", "size").alias("bucket"), "rep")
    n *= 2
    # The text that meets most others over all its buckets is likely to be the one that the others were made from.
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    open_ = cut(open_.join(sizes, "bucket"), n)
    met = open_.groupBy("rep").agg(F.sum("n").alias("met"))
    open_ = cut(open_.select("bucket", "rep").join(met, "rep").select("bucket", "rep", F.struct(F.negate("met").alias("met"), "rep").alias("turn")), n)
    leads = open_.groupBy("bucket").agg(F.min("turn").alias("lead")).select("bucket", F.col("lead.rep").alias("lead"))
    groups = cut(open_.join(leads, "bucket").where("rep <> lead").select("lead", "rep").coalesce(tasks_for(n)).distinct(), n)
    links = classes = None
    if not groups.isEmpty():
        used = groups.select(F.explode(F.array("lead", "rep")).alias("doc_id")).distinct()
        texts = docs.join(used, "doc_id", "left_semi")
        texts = cut(texts.groupBy("doc_id").agg(F.min("text").alias("text")))
        release(docs.sparkSession)
        groups = linked_leads(groups, texts, weights, threshold)
        n = groups.count()
        tried = cut(groups.select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b")).distinct(), n)
        links = cut(_jaccard(tried, texts, weights, threshold))
        classes = components(links)
        # Members outside their lead's class are apart.
        release(docs.sparkSession)
        own = classes.select(F.col("id").alias("rep"), F.col("class").alias("rep_class"))
        leads = classes.select(F.col("id").alias("lead"), F.col("class").alias("lead_class"))
        groups = groups.join(own, "rep", "left").coalesce(tasks_for(n)).join(leads, "lead", "left")
        apart = F.coalesce("rep_class", "rep") != F.coalesce("lead_class", "lead")
        groups = cut(groups.select("lead", "rep", apart.alias("apart"), F.coalesce("rep_class", "rep").alias("class")), n)
        sizes = groups.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("any")).where("n > 1 and any").drop("any")
        groups = cut(groups.join(sizes, "lead"), n)
        small, large = groups.where(F.col("n") <= SMALL_GROUP), groups.where(F.col("n") > SMALL_GROUP)
        others = small.select("lead", F.col("rep").alias("other"))
        more = small.where("apart").join(others, "lead").where("rep <> other").select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))
        if not large.isEmpty():
            more = more.unionByName(sharing_pairs(large, texts, weights, threshold))
        more = cut(more.distinct().join(tried, ["a", "b"], "left_anti"))
        n = more.count()
        more = more.coalesce(tasks_for(n))
        for x in ("a", "b"):
            more = more.join(classes.select(F.col("id").alias(x), F.col("class").alias(f"class_{x}")), x, "left").coalesce(tasks_for(n))
        more = cut(more.where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b"), n)
        links = cut(links.unionByName(_jaccard(more, texts, weights, threshold)))
        classes = components(links)
    base = signed.select("doc_id", "body", "whole", F.xxhash64("keys").alias("sig"))
    if links is None:
        named_class = reps.select("whole", "sig", F.col("rep").alias("class"), F.lit(0).cast("long").alias("n_links"))
    else:
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        named_class = reps.select("whole", "sig", "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left").join(degree, "rep", "left")
        named_class = named_class.select("whole", "sig", F.coalesce("class", "rep").alias("class"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = base.join(named_class, ["whole", "sig"], "left")
    own = F.col("doc_id").isNull() | F.col("whole").isNull()
    out = out.withColumns({"class": F.when(~own, F.col("class")), "n_links": F.when(own, F.lit(0).cast("long")).otherwise(F.col("n_links"))})
    smallest = F.col("class")
    if shared_ids is not None:
        # Names aren't ids here: a class goes by the smallest id of its rows, by partial minima.
        ids = out.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("smallest"))
        out, smallest = out.join(ids, "class", "left"), F.col("smallest")
    return out.select("doc_id", "body", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(smallest).alias("class_id"), "n_links", "class")


def near_classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links of the row's text to other texts; one row for each row of docs."""
    return classified(docs, threshold).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs that lead their class; all columns stay. Rows without a doc_id or without words all stay."""
    rows = cut(classified(docs, threshold).where("class is not null").select("doc_id", "body", "class_id", "class"))
    # The smallest id leads; if several texts of a class have it, the one with the smallest hash.
    leads = rows.where("doc_id = class_id").groupBy("class").agg(F.min("body").alias("lead"))
    late = rows.where("doc_id = class_id").join(leads, "class").where("body <> lead")
    gone = rows.where("doc_id <> class_id").select("doc_id", "body").unionByName(late.select("doc_id", "body")).distinct()
    gone = gone.select(F.col("doc_id").alias("__near_id"), F.col("body").alias("__near_body"))
    return docs.join(gone, (docs["doc_id"] == F.col("__near_id")) & (F.xxhash64(docs["text"]) == F.col("__near_body")), "left_anti").select(*docs.columns)
