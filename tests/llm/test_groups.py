"""Large groups of near copies, held against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from vexil.llm import near_dup


def _family(n: int, seed: int) -> list[str]:
    """Near copies of one text: words replaced, left out or put in, and some with a tail that a few share."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    tails = [[f"t{k}x{i}" for i in range(40)] for k in range(3)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(6)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 2)] = [] if kind == 1 else [f"n{rng.randrange(30)}"]
        out.append(" ".join(words + (rng.choice(tails) if i % 4 == 0 else [])))
    return out


def _weighed(texts: list[str], weights: near_dup.Weights) -> list[tuple[np.ndarray, np.ndarray]]:
    ids, count, ends, _ = near_dup.shingles(pa.array(texts))
    w = weights(ids, count)
    return [(ids[i:j], w[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]


def _jaccard(a: tuple, b: tuple) -> float:
    _, p, q = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][p], b[1][q]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def test_entries_lose_no_similar_pair():
    found = 0
    for seed in range(4):
        plain = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1000)
        lead, *texts = _weighed(_family(60, seed), plain)
        names = [np.concatenate(near_dup.names(lead, t, seed)[::2]) for t in texts]
        every, counts = np.unique(np.concatenate(names), return_counts=True)

        def level(name: np.ndarray, every=every, counts=counts) -> np.ndarray:
            return np.searchsorted(near_dup.LEVELS, counts[np.searchsorted(every, name)])

        kept = [near_dup.entries(lead, t, 0.8, seed, level) for t in texts]
        for i, x in enumerate(texts):
            if _jaccard(x, lead) >= 0.8:
                continue
            for j, y in enumerate(texts):
                if i != j and _jaccard(x, y) >= 0.8:
                    found += 1
                    assert np.intersect1d(kept[i][1], kept[j][0]).size
    assert found > 50


def test_classes_of_a_large_group(spark):
    texts = list(dict.fromkeys(_family(70, 9) + _family(30, 10)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_classes(docs).collect()}
    weighed = _weighed(texts, near_dup.common_shingles(docs))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and _jaccard(weighed[i], weighed[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert len(set(want)) > 2
    assert got == dict(enumerate(want))


def test_rooms_part_dissimilar_texts_and_no_similar_ones():
    made = unlike = found = 0
    for seed in range(4):
        plain = near_dup.Weights(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1000)
        lead, *texts = _weighed(_family(60, seed), plain)
        names = [np.concatenate(near_dup.names(lead, t, seed)[::2]) for t in texts]
        every, counts = np.unique(np.concatenate(names), return_counts=True)

        def level(name: np.ndarray, every=every, counts=counts) -> np.ndarray:
            return np.searchsorted(near_dup.LEVELS, counts[np.searchsorted(every, name)])

        kept = [near_dup.entries(lead, t, 0.8, seed, level) for t in texts]
        for i, x in enumerate(texts):
            if _jaccard(x, lead) >= 0.8:
                continue
            for j, y in enumerate(texts):
                _, p, q = np.intersect1d(kept[i][1], kept[j][0], return_indices=True)
                if i != j and p.size:
                    (room, part), (other_room, other_part) = (v[p] for v in kept[i][4:]), (v[q] for v in kept[j][2:4])
                    met = (np.minimum(room, other_room) >= part + other_part).any()
                    similar = _jaccard(x, y) >= 0.8
                    assert met or not similar
                    found, unlike, made = found + similar, unlike + (not similar), made + (met and not similar)
    assert found > 50 and unlike > 50 and made < 0.5 * unlike


def test_keys_that_are_put_together_have_the_largest_room(spark):
    x = [(1, 10, 0, 3.0), (2, 10, 0, 5.0), (3, 10, 0, 9.0)]
    y = [(1, 20, 1, 4.0), (2, 20, 1, 2.0), (3, 20, 1, 9.0), (3, 21, 2, 9.0)]
    sides = [spark.createDataFrame(rows, "key long, rep long, class long, room double") for rows in (x, y)]
    kept = [sorted((r.key, r.rep, r.room) for r in side.collect()) for side in near_dup.different_lists(*sides)]
    assert kept == [[(1, 10, 5.0), (3, 10, 9.0)], [(1, 20, 4.0), (3, 20, 9.0), (3, 21, 9.0)]]


def test_keys_of_the_same_texts_make_their_pairs_once(spark):
    x = [(key, rep, rep % 2, 1.0) for key in (1, 2, 3) for rep in (10, 11, 12)] + [(4, 10, 0, 1.0), (5, 10, 0, 1.0), (6, 10, 0, 1.0)]
    y = [(key, rep, rep % 2, 1.0) for key in (1, 2) for rep in (20, 21)] + [(3, 20, 0, 1.0), (3, 22, 0, 1.0), (4, 24, 0, 1.0), (5, 23, 1, 1.0)]
    sides = [spark.createDataFrame(rows, "key long, rep long, class long, weight double") for rows in (x, y)]

    def pairs(x, y):
        met = x.join(y.toDF("key", "other", "other_class", "other_weight"), "key").where("class <> other_class")
        return sorted((r.rep, r.other) for r in met.collect())

    kept = near_dup.different_lists(*sides)
    assert {r.key for r in kept[0].collect()} == {r.key for r in kept[1].collect()} == {1, 3, 5}
    assert set(pairs(*kept)) == set(pairs(*sides)) and len(pairs(*kept)) < len(pairs(*sides))
