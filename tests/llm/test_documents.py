"""Operators over documents against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vexil.llm import decontaminate, line_dedup, lm, mixing, near_dup, oracles, queries, token_counts, toxicity

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, score string, n_lines string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, a repeated row, a null id, a long text, and columns named like results."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, None, "a", "s", "n"), (2, "", "a", "s", "n"), (3, " \n\t\n ", None, "s", "n"), (4, "one two three four five six", "a", "s", "n"), (4, "one two three four five six", "a", "s", "n"), (None, "one two three four five six", "b", "s", "n"), (5, long, "b", "s", "n"), (6, long + " extra", "b", "s", "n")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def test_token_counts_equal_the_library(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.VOCABULARY)
    library = Tokenizer.from_file(path)
    texts = ["aaaaaaa", "Don't STOP!!! 42²", "éÉ İıſ Σς", "a<|endoftext|>b <|startoftext|>", "日本語 한국 🎉\x1c\x85", "́é", "x" * 3000]
    more = spark.createDataFrame([(100 + i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = token_counts.token_counts(odd.select("doc_id", "text").unionByName(more), path).collect()
    want = sorted(((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in [*((r.doc_id, r.text) for r in odd.collect()), *enumerate(texts, 100)]), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_lines_near_an_earlier_one_go(spark, odd, empty):
    base = "the quick brown fox jumps"
    docs = [(1, f"{base}\nshort\n\nshort"), (2, f"{base[:-1]}\nthe quick brown fix jumps\nsharks"), (3, f"  {base} \nanother line that stays"), (4, "another line that stays" + "!" * 2), (5, "z" * 3000 + "a"), (6, "z" * 3000 + "b"), (7, None)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].text for i in range(1, 8)] == [f"{base}\nshort\n", "sharks", "another line that stays", "another line that stays!!", "z" * 3000 + "a", "", None]
    assert got[7].n_lines == 0 and got[6].n_lines == 1 and got[6].n_kept == 0
    tiny = [(0, "a\nab\nxyz"), (1, "b\nabc\nc\nxz"), (2, "q r\n\nq s")]
    same = spark.createDataFrame([(*r, "k", "r") for r in tiny], "doc_id long, text string, kept string, row string").unionByName(spark.createDataFrame([(2, "other\nq r", "k", "r")], "doc_id long, text string, kept string, row string"))
    got = sorted((r.doc_id, r.text, r.kept, r.row, r.n_kept) for r in line_dedup.dedup_lines(same).collect())
    assert [x[:1] + x[2:4] for x in got] == [(0, "k", "r"), (1, "k", "r"), (2, "k", "r"), (2, "k", "r")]
    assert got[0][1] == "a\nxyz" and got[1][1] == ""
    out = line_dedup.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "source", "score", "n_lines", "n_kept"] and out.count() == odd.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_and_decontamination_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in oracles.SQL.items():
        want = con.execute(sql).df()
        order = sorted(want.columns)
        got = queries.QUERIES[name](spark, SMALL).toPandas()
        plain = lambda v: "" if v is None or v != v else str(int(v)) if isinstance(v, float) else str(v)
        a, b = (sorted(tuple(map(plain, r)) for r in x[order].astype(object).itertuples(index=False, name=None)) for x in (got, want.astype(object).where(want.notna(), None)))
        assert a == b, name


def test_masks_hit_every_window_that_counts():
    for w in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        for bad in itertools.combinations(range(w), w - math.ceil(w * 80 / 100)):
            masks = decontaminate.MASKS if w >= decontaminate.LONG else decontaminate.SHORT_MASKS
            assert any(all(p + i not in bad for i in m) for m in masks for p in range(w - m[-1]))


def test_decontamination_cases(spark, odd, empty):
    words = [f"word{i}" for i in range(20)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "one two three"), (3, None), (4, "")], "item_id long, text string")
    two, three = words.copy(), words[:13]
    two[3] = two[9] = "other"
    for i in (2, 6, 10):
        three[i] = "other"
    docs = [(1, f"start {' '.join(words).upper()}! end"), (2, " ".join(two)), (3, " ".join(three)), (4, "one two three four"), (5, " ".join(words[:12])), (None, " ".join(words))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, items).collect()} == {(1, 1), (2, 1), (None, 1)}
    assert {r.doc_id for r in decontaminate.clean(df, items).collect()} == {3, 4, 5}
    some = spark.createDataFrame([(9, "alpha beta gamma delta epsilon"), (9, "one two three four five six seven"), (8, "what is it now")], "item_id long, text string")
    more = [(1, "an alpha beta gama delta epsilon end"), (2, "alpha beta x y epsilon"), (3, "one two three FOUR 5 six seven"), (4, "what is it now"), (4, "alpha beta gamma delta"), (5, "so alpha beta gamma delta")]
    clashing = spark.createDataFrame([(*r, 7, 7) for r in more], "doc_id long, text string, bad_id int, item_id int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(clashing, some).collect()} == {(1, 9), (3, 9)}
    assert sorted((r.doc_id, r.bad_id) for r in decontaminate.clean(clashing, some).collect()) == [(2, 7), (4, 7), (4, 7), (5, 7)]
    assert decontaminate.leaks(odd, items).count() == 0 and decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.clean(odd, items.limit(0)).count() == odd.count()


def test_seeds_run_over_the_ends_of_runs(spark, monkeypatch):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(50)))], "doc_id long, text string").select("doc_id", decontaminate.words().alias("h"))
    want = sorted(tuple(r) for r in decontaminate.seeds(df, "doc_id").collect())
    assert decontaminate.seeds(df, "doc_id").columns == ["doc_id", "pos", "seed"]
    monkeypatch.setattr(decontaminate, "_RUN", 7)
    assert sorted(tuple(r) for r in decontaminate.seeds(df, "doc_id").collect()) == want
    assert len(want) == sum(50 - m[-1] for m in decontaminate.MASKS)


@pytest.mark.parametrize("small", [False, True])
def test_lm_scores_against_counting(spark, odd, empty, monkeypatch, small):
    if small:  # several files, and words whose successors are dealt over them
        for name, value in (("WORD_BYTES", 40), ("FILE_TOKENS", 20), ("OFTEN", 5), ("_PENDING", 4)):
            monkeypatch.setattr(lm, name, value)
    rows = [(i, t) for i, t in enumerate(["a b c", "A b\tc d", "a b a b", None, "", "é É x", "q", "b a b c d a", "a b c a b d"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    train = [split(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    seen, total, kinds = Counter(), Counter(), Counter()
    for ws in train:
        marked = [0, *ws]
        for i, w in enumerate(ws):
            for context in [(marked[i],)] + [(marked[i - 1], marked[i])] * (i > 0):
                kinds[context] += not seen[context, w]
                seen[context, w] += 1
                total[context] += 1
    for r in lm.lm_scores(df).collect():
        ws = split(dict(rows)[r.doc_id])
        marked = [0, *ws]
        base = {w: (c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in ws}
        real = []
        for i, w in enumerate(ws):
            p = base[w]
            for context in [(marked[i],)] + [(marked[i - 1], marked[i])] * (i > 0):
                if total[context]:
                    p = max(seen[context, w] - 0.75, 0) / total[context] + 0.75 * kinds[context] / total[context] * p
            real.append(p)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10(base[w]) for w in ws))
        assert r.score == pytest.approx(sum(map(math.log10, real)), abs=1e-3 * len(ws))
    assert lm.lm_scores(odd).count() == odd.count()
    assert lm.lm_scores(empty).count() == 0


def test_toxicity_learns_a_word_and_keeps_odd_rows(spark, odd, empty):
    rows = [(i, f"some plain words w{i % 7} {'scum' if i % 3 == 0 else 'nice'} and w{i % 11}", int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity_scores(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    assert all(r.predicted == (r.doc_id % 3 == 0) == (r.score >= 0.5) for r in got)
    model = toxicity.train_on(df, df)
    assert len(model["at"]) < 300
    out = toxicity.score(odd, model, keep_text=True)
    assert out.count() == odd.count() and out.columns.count("score") == 1
    none = toxicity.toxicity_scores(odd, df.limit(0)).collect()
    assert {r.predicted for r in none} == {0} and all(0 < r.score < 0.5 for r in none)
    # Null labels, labels that contradict each other, and labels of no document.
    strange = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(0, None), (1, 1), (1, 0), (10**6, 1)], "doc_id long, toxic int"))
    assert toxicity.toxicity_scores(df.select("doc_id", "text"), strange).count() == 300
    assert toxicity.toxicity_scores(empty, df).count() == 0


def test_toxicity_follows_plain_updates(spark):
    """The fit against coordinate by coordinate updates of one row after the other."""
    rng = random.Random(3)
    rows = [([rng.randrange(40) for _ in range(rng.randrange(1, 9))], rng.randrange(2)) for _ in range(200)]
    how = toxicity.Ftrl(bits=6, alpha=0.3, beta=0.7, l1=0.4, l2=0.2, epochs=2)
    z, n, bias = Counter(), Counter(), 64

    def weight(i):
        l1 = 0.0 if i == bias else how.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for at, y in rows:
            at = [*set(at), bias]
            g = 1 / (1 + math.exp(-sum(map(weight, at)))) - y
            for i in at:
                w, sigma = weight(i), (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha
                z[i] += g - sigma * w
                n[i] += g * g
    at, w, b = toxicity._fit([(y, np.array([*sorted(set(x)), bias], np.int32)) for x, y in rows], how)
    assert b == pytest.approx(weight(bias))
    assert dict(zip(at.tolist(), w)) == pytest.approx({i: weight(i) for i in range(64) if weight(i)})


def test_near_classes_against_all_pairs(spark, odd, empty):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(5):
            t = base.copy()
            for p in rng.integers(0, 60, rng.integers(0, 3)):
                t[p] = f"r{rng.integers(10**9)}"
            texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, count, ends, _ = near_dup.shingles(pa.array(texts))
    weight = near_dup.common_shingles(df)(ids, count)
    sets = [dict(zip(ids[ends[k] : ends[k + 1]].tolist(), weight[ends[k] : ends[k + 1]])) for k in range(len(texts))]
    of = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = sum(min(w, sets[b][x]) for x, w in sets[a].items() if x in sets[b])
        if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of]
    assert {r.doc_id: r.class_id for r in near_dup.near_classes(df).collect()} == dict(enumerate(of))
    assert {r.doc_id for r in near_dup.keep_one(df).collect()} == set(of)
    got = {(r.doc_id, r.class_id) for r in near_dup.near_classes(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (None, None), (5, 5), (6, 5)}
    assert near_dup.near_classes(empty).count() == 0 and near_dup.keep_one(odd).count() == odd.count() - 1


def test_mix_keeps_all_and_follows_weights(spark, odd, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"))
    weights = {"a": 0.5, "b": 0.3, None: 0.2}
    rows = mixing.mix_sources(docs, weights, block=10, period=100).collect()
    assert len(rows) == 3000 and len({r.doc_id for r in rows}) == 3000
    assert all(r.release <= r.slot < r.deadline for r in rows)
    at = sorted({(r.slot, r.source or "") for r in rows if r.in_mix})
    assert [s for s, _ in at] == list(range(len(at))) and len(at) >= 180
    got = Counter()
    for k, (_, source) in enumerate(at, 1):
        got[source] += 1
        assert all(abs(got[x or ""] - w * k) < 1 for x, w in weights.items())
    assert mixing.mix_sources(odd).count() == odd.count()
    assert mixing.mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"a": 1.0})


def test_pipeline_runs_and_its_decisions_hold(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    assert 0 < out.count() <= docs.count() and set(corpus_pipeline.COLUMNS) <= set(out.columns)
    assert decontaminate.leaks(out, spark.read.parquet(f"{SMALL}/benchmark.parquet")).count() == 0
    assert near_dup.near_classes(out).where("doc_id <> class_id").count() == 0
