"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, of its pairs of neighbouring words and of its pairs of words
with one word between, in 2**bits coordinates. Each coordinate has a learning rate of its own, and the L1 term leaves most
weights at exactly zero, so that the model is a short list that every task can hold (2**bits entries at most).

Defined cases: a null or empty text has no features and gets the bias alone; repeated documents get equal scores; labels
of null are left out, and a doc_id with several labels counts as toxic if one of them says so; with no labelled rows
every score is that of the bias UNTRAINED, below one half. A document is predicted toxic if and only if its score is at least
one half. Other columns of the inputs are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.ragged import doc_of, hash_words, mix, text_blocks
from vexil.llm.shared import small_batches

_WORDS = 1 << 17  # of a block of texts: its features take some 30 MB
#: The bias of a model that has learnt from nothing.
UNTRAINED = -1.0


@dataclass(frozen=True)
class Ftrl:
    """max_rows and max_bytes bound the labelled rows that the fit reads and their texts (about; chosen by a hash of the id)."""

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 3
    max_rows: int = 20_000
    max_bytes: int = 64 << 20


def features(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every n-gram, repeats included."""
    h, off = hash_words(text)
    doc = doc_of(off)
    rows, coords = [doc], [h]
    for gap, a, b in ((1, 0xA24BAED4963EE407, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)):
        same = doc[:-gap] == doc[gap:]
        rows.append(doc[:-gap][same])
        coords.append(mix(h[:-gap][same] * np.uint64(a) + h[gap:][same] * np.uint64(b)))
    return np.concatenate(rows), (np.concatenate(coords) >> np.uint64(64 - bits)).astype(np.int64)


def _fit(rows: list[tuple[int, np.ndarray]], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    size = 1 << how.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, how.l1)
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for y, at in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / how.alpha * w
            n[at] = grown
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:size])
    return at, w[at], float(w[size])


def train(labelled: DataFrame, how: Ftrl = Ftrl()) -> dict:
    """labelled: doc_id, text, toxic. One task runs the sequential updates over the bounded sample, in an order set by a hash of the id."""
    bits = how.bits
    small_batches(labelled.sparkSession)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_blocks(b["text"], _WORDS):
                part = b.slice(i, j - i)
                row, at = features(part["text"], bits)
                key = np.unique(row << bits | at)
                ends = np.searchsorted(key >> bits, np.arange(len(part) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part["k"], part["doc_id"], part["toxic"].cast(pa.int32()), lists], ["k", "doc_id", "toxic", "at"])

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(int(y), np.append(a, np.int32(1 << bits)).astype(np.int32)) for f in frames for y, a in zip(f["toxic"], f["at"])]
        at, w, bias = _fit(rows, how)
        yield pd.DataFrame({"at": np.append(at, -1).astype(np.int64), "w": np.append(w, bias)})

    named = labelled.select(F.md5(F.col("doc_id").cast("string")).alias("k"), "doc_id", "text", "toxic")
    rows = named.mapInArrow(featurise, "k string, doc_id long, toxic int, at array<int>").repartition(1).sortWithinPartitions("k", "doc_id")
    model = rows.mapInPandas(fit, "at long, w double").toPandas()  # 2**bits + 1 rows at most
    real = model["at"] >= 0
    return {"bits": bits, "at": model["at"][real].to_numpy(), "w": model["w"][real].to_numpy(), "bias": float(model["w"][~real].sum()) if len(model) else UNTRAINED}


def score(docs: DataFrame, model: dict, keep_text: bool = False) -> DataFrame:
    """docs: doc_id, text, and whatever else, all of which stays (the text if asked for). Adds score and predicted, in place of columns of these names."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("score", "predicted") and (keep_text or c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = np.zeros(1 << m["bits"])
        dense[m["at"]] = m["w"]
        used = dense != 0
        for b in batches:
            out = np.full(len(b), m["bias"])
            for i, j in text_blocks(b["text"], _WORDS):
                row, at = features(b["text"].slice(i, j - i), m["bits"])
                hit = used[at]
                key = np.unique(row[hit] << m["bits"] | at[hit])
                out[i:j] += np.bincount(key >> m["bits"], dense[key & ((1 << m["bits"]) - 1)], j - i)
            p = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, f"{schema}, score double, predicted int")


def fold_of(doc_id: str = "doc_id") -> F.Column:
    """0 to 4; rows of 0 are held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def train_on(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> dict:
    """Fits on labelled documents outside the held-out fold: on all, or on a sample of about how.max_rows of them with how.max_bytes of text."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold_of() != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # Only ids and lengths are shuffled to size the sample.
    n = known.count()
    size = docs.select("doc_id", F.octet_length("text").alias("b")).join(known, "doc_id").agg(F.sum("b").alias("b")).first()["b"] if n else 0
    if not n:
        return {"bits": how.bits, "at": np.zeros(0, np.int64), "w": np.zeros(0), "bias": UNTRAINED}
    share = min(how.max_rows / n, how.max_bytes / max(size or 0, 1))
    if share < 1:
        known = known.where(F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))) < int(share * 2**32))
    # The sample has a bound, so it may be sent to every task.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return train(texts, how)


def toxicity_scores(docs: DataFrame, labels: DataFrame, how: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = score(docs.select("doc_id", "text"), train_on(docs, labels, how))
    return out.select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted")
