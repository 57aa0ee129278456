"""Cases that an earlier round's code left out."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexil.llm import line_dedup, mixing, near_dup


def _dealt(weights: list[int], blocks: list[int]) -> list[tuple[int, int, int]]:
    """(slot, source, block) by looking at every block for every slot."""
    total = sum(weights)
    left = {(k, i): (Fraction(i * total, w).__floor__(), Fraction((i + 1) * total, w).__ceil__()) for k, (w, n) in enumerate(zip(weights, blocks)) for i in range(n)}
    out, slot = [], 0
    while left:
        free = [(due, k, i) for (k, i), (release, due) in left.items() if release <= slot]
        if free:
            _, k, i = min(free)
            del left[k, i]
            out.append((slot, k, i))
        slot += 1
    return out


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 9)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_schedule_against_every_slot(sources):
    weights, blocks = zip(*sources)
    got = [(slot, k, i) for k, i, _, _, slot, _ in mixing.schedule(list(weights), sum(weights), list(blocks))]
    assert got == _dealt(list(weights), list(blocks))


def test_mix_against_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(500)]
    weights = {"a": 0.5, "b": 0.25, "c": 0.125, None: 0.125}
    names = sorted(weights, key=lambda x: (x is not None, x or ""))
    lines = {x: sorted((i for i, s in rows if s == x), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()) for x in names}
    slots = {(names[k], i): slot for slot, k, i in _dealt([int(weights[x] * 8) for x in names], [-(-len(lines[x]) // 7) for x in names])}
    want = {i: (x, slots[x, at // 7], at % 7) for x, line in lines.items() for at, i in enumerate(line)}
    docs = spark.createDataFrame([(*r, "k", "r") for r in rows], "doc_id long, source string, __k string, row string")
    out = mixing.mix_sources(docs, weights, block=7)
    assert out.columns[:4] == docs.columns
    assert {r["doc_id"]: (r["source"], r["slot"], r["place"]) for r in out.collect()} == want


def test_many_rows_of_one_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_ROWS", 20)
    rows = [(None, "a", i) for i in range(300)] + [(7, "a", 0)] * 200 + [(i, "b" if i % 2 else "a", 0) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long")
    out = mixing.mix_sources(docs, block=10).collect()
    assert Counter((r["doc_id"], r["source"], r["n"]) for r in out) == Counter(rows)
    assert max(Counter((r["source"], r["slot"], r["place"]) for r in out).values()) == 1
    for source, n in Counter(s for _, s, _ in rows).items():
        assert {(r["block"], r["place"]) for r in out if r["source"] == source} == {(i // 10, i % 10) for i in range(n)}
    parts = mixing._split(docs.select(F.struct("doc_id").alias("row"), F.lit("+a").alias("s"), F.lit("k").alias("key"), F.lit("0").alias("bucket")), 20)
    assert parts.groupBy("part").count().agg(F.max("count")).first()[0] <= 40


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    from vexil.llm.shared import shared_dir

    base = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None, None, "a", None), (2, "", "en", "a", 0), (3, base, "en", None, 1), (3, base, "en", None, 1), (4, base + " more", "en", "a", 1), (5, "x" * 100_000, "en", "b", 1), (None, "some other text", None, "b", 1)]
    rows += [(6, "a passage of the benchmark that is long enough to be found here again and again", "en", "a", 1), (3, "the same id but another text", "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"
    spark.createDataFrame([(*r, "s", "r") for r in rows], schema).write.parquet(str(tmp_path / "odd/documents.parquet"))
    spark.createDataFrame([(1, "passage of the benchmark that is long enough to be found here again and again")], "item_id long, text string").write.parquet(str(tmp_path / "odd/benchmark.parquet"))
    spark.createDataFrame([(3, 0), (None, 1), (99, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "odd/labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    kept = Counter((r["doc_id"], r["text"]) for r in out)
    # Of 3 and 4, which are near copies, the first stays, and 6 holds a passage of the benchmark.
    assert kept == Counter([(1, None), (2, ""), (3, base), (3, base), (3, "the same id but another text"), (5, "x" * 100_000), (None, "some other text")])
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"odd/{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    before = set(os.listdir(shared_dir(spark)))
    empty = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and set(corpus_pipeline.COLUMNS) <= set(empty.columns)
    new = [x for x in set(os.listdir(shared_dir(spark))) - before if x.startswith("corpus-")]
    assert len(new) == 1 and len(os.listdir(f"{shared_dir(spark)}/{new[0]}")) == 1


def _similar(texts: list[str], weights: near_dup.Weights, i: int, j: int) -> bool:
    ids, count, ends, _ = near_dup.shingles(pa.array([texts[i], texts[j]]))
    w, at = weights(ids, count), ends[1]
    _, p, q = np.intersect1d(ids[:at], ids[at:], assume_unique=True, return_indices=True)
    both = np.minimum(w[:at][p], w[at:][q]).sum()
    return both >= 0.8 * (w.sum() - both)


def test_copies_whose_large_buckets_differ(spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(200)]
    texts, pairs = [], []
    for i in range(800):
        own = [f"d{i}x{k}" for k in range(100)]
        texts.append(" ".join(passage + own))
        if i < 200:
            for at in rng.sample(range(5, 95), 3):
                own[at] = f"e{i}x{at}"
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(" ".join(passage + own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = near_dup.common_shingles(docs)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(docs).collect()}
    close = [(i, j) for i, j in pairs if _similar(texts, weights, i, j)]
    assert len(close) > 100
    assert [(i, j) for i, j in close if got[i] != got[j]] == []


def test_texts_that_share_an_id(spark):
    rng = random.Random(8)
    x, y, z = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(80)) for k in "xyz")
    near = y + " more"
    rows = [(3, y), (7, x), (7, y), (8, near), (9, z), (9, z), (9, x + " also"), (None, y), (None, y)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, body string")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dup.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, y), (7, x), (9, z), (9, z), (None, y), (None, y)], key=str)
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_dup.near_classes(docs).collect()), key=str)
    assert got == sorted([(3, 3), (7, 7), (7, 3), (8, 3), (9, 9), (9, 9), (9, 7), (None, None), (None, None)], key=str)


def test_chain_of_leads_keeps_groups_together(spark):
    rng = random.Random(6)
    versions = [[f"v{i}" for i in range(200)]]
    for k in range(5):
        words = list(versions[-1])
        for at in rng.sample(range(5, 195), 3):
            words[at] = f"n{k}x{at}"
        versions.append(words)
    texts = [" ".join(x) for x in versions]
    # Versions 0, 1 and 2 lead ever smaller groups, and each is in the group before.
    groups = [(0, 1), *((0, i) for i in range(100, 106)), (1, 2), *((1, i) for i in range(200, 204)), (2, 3), (2, 4)]
    every = {x: texts[x] if x < len(texts) else f"text {x} of other words" for g in groups for x in g}
    weights = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1000)
    assert _similar(texts, weights, 0, 1) and _similar(texts, weights, 1, 2) and not _similar(texts, weights, 0, 2)
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    out = near_dup.linked_leads(spark.createDataFrame(groups, "lead long, rep long"), docs, weights, 0.8)
    members = {}
    for r in out.collect():
        members.setdefault(r["lead"], {r["lead"]}).add(r["rep"])
    for lead in (0, 1, 2):
        old = {lead, *(b for a, b in groups if a == lead)}
        assert any(old <= new for new in members.values()), lead
    assert 1 not in members


def _within_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a[same + (len(a) == len(b)) :] == b[same + 1 :]


def test_lines_of_neighbouring_lengths(spark):
    rng = random.Random(7)
    lines = []
    for n in range(10, 71):
        for at in (0, n // 2, n, rng.randrange(n)):
            shorter = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
            pair = [shorter, shorter[:at] + "7" + shorter[at:]]
            lines += pair[:: rng.choice((1, -1))]
    want = {i for i, x in enumerate(lines) if not any(_within_one(x, y) for y in lines[:i])}
    assert len(want) == len(lines) // 2
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).where("n_kept = 1").select("doc_id").collect()
    assert {r["doc_id"] for r in got} == want


def test_mix_of_twenty_skewed_sources(spark):
    counts = [60_000, *(1000 + 250 * k for k in range(19))]
    weights = {f"s{k}": 0.5 if k == 0 else 0.5 * (k + 1) / 209 for k in range(20)}
    total = sum(map(Fraction, weights.values()))
    ids = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(counts)], "source string, n long")
    docs = ids.select("source", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(F.xxhash64("source", "i").alias("doc_id"), "source")
    out = mixing.mix_sources(docs, weights, block=2, period=20)
    assert out.count() == sum(counts)
    rows = out.select("slot", "source", "release", "deadline", "in_mix").distinct().collect()
    assert len({r["slot"] for r in rows}) == len(rows) == sum(-(-n // 2) for n in counts)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    dealt = [r["source"] for r in sorted(rows, key=lambda r: r["slot"]) if r["in_mix"]]
    assert len(dealt) > 5000
    got = Counter()
    for k, source in enumerate(dealt, 1):
        got[source] += 1
        assert all(abs(got[x] - Fraction(w) / total * k) < 1 for x, w in weights.items())
