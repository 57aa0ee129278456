"""Archives, chat windows, neighbours and Elias-Fano lists."""

import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vexil.llm import ann, chat, warc
from vexil.llm.elias_fano import EliasFano, encode, map_file, to_bytes

CONTROL = st.text(st.sampled_from(list("<>[]|\\/s\nINSTim_endSYa")), max_size=30) | st.sampled_from(["<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_start|>", "<<SYS>>", "<\\\\s>"])


@given(CONTROL, CONTROL)
@settings(max_examples=500, deadline=None)
def test_escaping_is_reversible_and_hides_marks(text, role):
    body = chat.escape(text)
    assert chat.unescape(body) == text and chat.START not in body and chat.STOP not in body
    whole = f"{chat.START}{chat.escape_role(role)}\n{body}{chat.STOP}\n"
    assert [(r, t) for r, t, _, _ in chat.read_window(whole)] == [(role, text)]


def test_windows_hold_the_budget_and_digests_come_back(spark):
    turns = [(1, 0, "system", "be nice")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 5) + "</s>") for i in range(1, 40)]
    turns += [(2, 0, "assistant", "x " * 300), (2, 1, None, None), (None, 0, "user", "a"), (3, None, "assistant", "b"), (3, None, "assistant", "b")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget=40).cache()
    for w in windows.where("conv_id = 1").collect():
        read = chat.read_window(w.text)
        assert read[0][:2] == ("system", "be nice") and sum(len(f"{r} {t}".split()) + chat.MARKS for r, t, _, _ in read) <= 40 and w.repeated < len(read)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in sorted((x for x in turns if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(said)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.chat_digests(df.limit(0)).count() == 0


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(1, 30)), min_size=1, max_size=40), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=300, deadline=None)
def test_spans_against_adding_up(turns, budget, history):
    """Windows by running sums against a plain count of what fits."""
    now, got = chat._Conversation(1, budget, history), []
    for i, (role, size) in enumerate(turns):
        got.append(now.add(role, f"t{i}", size))
    got = [x for x in [*got, now.window()] if x]
    system, at, want = turns[0][0] == "system", 0, []
    while at < len(turns):
        free = budget - (turns[0][1] if system and at else 0)
        low, used = at, 0
        while low > max(at - history, 1 if system else 0) and used + turns[low - 1][1] <= max(free, 0) // 2:
            low -= 1
            used += turns[low][1]
        end, used = at + 1, used + turns[at][1]
        while end < len(turns) and used + turns[end][1] <= free:
            used += turns[end][1]
            end += 1
        want.append(([0] if system and at else []) + list(range(low, end)))
        at = end
    assert [[int(t[1:]) for _, t, _, _ in chat.read_window(w["text"])] for w in got] == want


def test_windows_count_tokens_of_the_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame([(1, i, "user", f"unquestionably {'so ' * i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    for r in chat.sized(df, path).collect():
        assert r.tokens == chat.MARKS + sum(len(library.encode(x, add_special_tokens=False).ids) for x in (r.role, r.text))


def test_archives_round_trip(spark):
    pages = [(5, "http://a/é b", "<p>é\r\n\r\nx</p>"), (2, None, "<p>é\r\n\r\nx</p>"), (9, "u", None), (3, "u", ""), (None, "u", ""), (7, "u", "only"), (7, "u", "only"), (None, None, "lone")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, digest string")
    rows = warc.read_archives(spark, warc.write_archives(df), with_payload=True).collect()
    first = {"<p>é\r\n\r\nx</p>": 2, "": 3, "only": 7, "lone": None}
    want = []
    for p, _, h in pages:
        body = (h or "").encode()
        revisit = first[h or ""] is not None and p != first[h or ""]
        want.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None, b"" if revisit else body))
    assert sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in rows), key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(df.limit(0)).count() == 0
    small = warc.read_archives(spark, warc.write_archives(df, least_bytes=5))
    assert {r.page_id for r in small.where("record_type = 'revisit'").collect()} == {5}


def brute(vectors, every, k):
    v = {i: np.array(x, float) for i, x in vectors}
    out = {}
    for q in (i for i in v if i % every == 0):
        s = sorted((-float(v[q] @ v[i] / np.sqrt(v[q] @ v[q]) / np.sqrt(v[i] @ v[i])), i) for i in v if i != q)
        out[q] = [i for _, i in s[:k]]
    return out


def test_factor_one_is_exact_and_odd_vectors_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_BYTES", 300 * 8 * 8)
    monkeypatch.setattr(ann, "BLOCK", 4)
    monkeypatch.setattr(ann, "SPAN", 2)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    rows[450] = (450, rows[100][1])
    odd = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [None] + [1.0] * 7), (2005, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, embedding array<float>, dim int")
    want = brute(rows, 50, 5)
    got = {}
    for r in ann.nearest(df, factor=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want
    near = ann.nearest(df).collect()
    assert sum(r.vec_id in want[r.query_id] for r in near) / sum(map(len, want.values())) >= 0.9
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0], 0)], df.schema)).count() == 0


@pytest.mark.parametrize("factor", [1.0, 0.6])
@pytest.mark.parametrize("dim", [32, 63, 64, 100])
def test_ties_of_many_equal_vectors_go_to_the_smallest_ids(dim, factor):
    rng = np.random.default_rng(dim)
    raw = rng.normal(size=(3000, dim)).astype(np.float32)
    ids = rng.permutation(3000)
    same = rng.choice(3000, 400, replace=False)
    raw[same] = raw[same[0]]
    raw[same[:50]] *= 2  # another length, the same direction
    asked = np.concatenate([same[:20], rng.choice(3000, 20, replace=False)])
    q, at, score = ann.Searcher(ann.build(ann.unit(raw)), raw, ids, raw[asked], ids[asked], 5, factor).run()
    for k, i in enumerate(asked):
        every = ann.cosine(np.repeat(raw[i][None], 3000, 0), raw)
        order = [j for j in np.lexsort((ids, -every)) if j != i][:5]
        got = at[q == k]
        if factor == 1 or i in same:
            assert ids[got].tolist() == ids[order].tolist()
        assert (score[q == k] == every[got]).all()


def test_recall_on_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = brute(rows, 50, 5)
    got = ann.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).collect()
    assert sum(r.vec_id in want[r.query_id] for r in got) / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("n, top", [(0, 5), (1, 0), (50, 3), (1000, 10**12), (2000, 2000)])
def test_successors(tmp_path, n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top + 1, n))
    (tmp_path / "f").write_bytes(to_bytes(encode("x", v)))
    q = np.concatenate([v, rng.integers(0, top + 9, 200)])
    place, same = EliasFano(map_file(str(tmp_path / "f")), "x").successor(q)
    assert (place == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()
