"""LM scoring: a three-level n-gram trie in Elias-Fano lists, in memory-mapped files.

Level one holds the words that something follows, level two each such word's successors, level three the successors of each
pair. Monotone pointers say where a node's successors begin in the level below. A successor w of a node with c successors from
place b on is stored as b * W + w * c (W: the number of words and marks), which rises along the level and is spread evenly, however
many successors a node has; so a word is found by a successor search relative to its context, in a few steps. The trie
keeps no counts but 16-bit codes of smoothed probabilities: of each n-gram its discounted share of its context, of each context
the mass that goes to the next shorter one,
p(w | uv) = max(c(uvw) - D, 0) / c(uv) + D * T(uv) / c(uv) * p(w | v), with T(uv) distinct successors, and so on down to the base p(w).
Everything comes from all training texts: no count is cut off. A word's subtree is in one file, but the successors of words that occur often
are dealt over several by ranges, so that no task builds more than about a file's share of the corpus. What a word pair
can gather in one file is bounded by the vocabulary: its counts are summed as they come.

Defined cases: a null or empty text is the end token alone; words are runs without blanks, A-Z lowered; with no training
texts every token has the base probability of an unknown one; repeated rows are trained on and scored as often as they occur;
a null doc_id is trained on or held out as the text '' is; other columns aren't read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.elias_fano import EliasFano, encode, map_file, to_bytes
from vexil.llm.ragged import BLANKS, doc_of, hash_words, mix, text_blocks
from vexil.llm.shared import cut, local_path, new_folder, put_file, remove, small_batches

END = np.uint64(0xE7037ED1A0B428DB)  # stands for the hash of the end token
DISCOUNT = 0.75
_STEP = 16 / 65535  # codes are steps of log10, 0 for one and 65535 for 1e-16
WORD_BYTES = 128 << 20  # of text that one vocabulary file counts
FILE_TOKENS = 4 << 20  # that one file of the trie is built from
#: A word that occurs more often has its successors dealt over several files; so there are at most tokens / OFTEN of these words.
OFTEN = FILE_TOKENS // 4
_PENDING = 2 << 20  # n-grams that wait to be summed


def fold_of(doc_id: str = "doc_id") -> F.Column:
    """0 to 4; rows of 1 are held out. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def _code(p: np.ndarray) -> np.ndarray:
    """Rounded down, so that the shares of a context don't exceed one."""
    return np.ceil(np.clip(-np.log10(np.maximum(p, 1e-16)) / _STEP, 0, 65535)).astype(np.uint16)


_VALUES = 10.0 ** (-np.arange(65536) * _STEP)


@dataclass(frozen=True)
class Model:
    """What tasks need besides the files. first_id: the first word number of each vocabulary file. often, totals, rest: numbers
    of the words that are dealt over files, how often something follows them, and the mass of theirs that goes to single words.
    part: how many of their tokens a file gets."""

    folder: str
    first_id: tuple[int, ...]
    types: int
    tokens: int
    files: int = 1
    part: int = OFTEN
    often: np.ndarray | None = None
    totals: np.ndarray | None = None
    rest: np.ndarray | None = None

    @property
    def begin(self) -> int:
        return self.types  # the number of the mark before the first word

    @property
    def width(self) -> int:
        return self.types + 2  # words, the mark before the first one and the mark after the end

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def often_at(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word among those dealt over files, and whether it is one."""
        if not len(self.often):
            return np.zeros(len(u), np.int64), np.zeros(len(u), bool)
        at = np.minimum(np.searchsorted(self.often, u), len(self.often) - 1)
        return at, self.often[at] == u

    def file_of(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The file that has the successors v of u."""
        first = (mix(u.astype(np.uint64)) % np.uint64(self.files)).astype(np.int64)
        at, split = self.often_at(u)
        if split.any():
            parts = np.minimum(self.totals[at[split]] // self.part + 1, self.files)
            first[split] = (first[split] + v[split] * parts // self.width) % self.files
        return first


@lru_cache(maxsize=4096)
def _open(path: str) -> dict[str, np.ndarray]:
    return map_file(path)


def _shrink(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob, byte plane by byte plane."""
    raw, heads = [], []
    for a in arrays:
        small = np.ascontiguousarray(a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)))
        heads.append(small.dtype.str)
        raw.append(small.view(np.uint8).reshape(len(a), -1).T.tobytes())
    whole = b"".join(raw)
    head = json.dumps([len(arrays[0]), len(whole), heads]).encode()
    return len(head).to_bytes(4, "little") + head + pa.compress(whole, codec="zstd", asbytes=True)


def _grow(blob: bytes) -> list[np.ndarray]:
    start = 4 + int.from_bytes(blob[:4], "little")
    n, size, kinds = json.loads(blob[4:start])
    raw, out, at = np.frombuffer(pa.decompress(blob[start:], size, codec="zstd"), np.uint8), [], 0
    for kind in kinds:
        wide = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).reshape(n).astype(np.int64 if wide < 8 else kind))
        at += n * wide
    return out


def _heads(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = _heads(keys)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token hashes, each token's place among them, and the token offsets of the texts; each text ends with END."""
    h, off = hash_words(text, BLANKS)
    n = len(off) - 1
    ends = off[1:] + np.arange(n)
    out = np.empty(len(h) + n, np.uint64)
    out[ends] = END
    free = np.ones(len(out), bool)
    free[ends] = False
    out[free] = h
    distinct, place = np.unique(out, return_inverse=True)
    return distinct, place, np.append(0, ends + 1)


def _dealt(hashes: np.ndarray, files: int) -> np.ndarray:
    """Vocabulary file of each hash; files hold ranges, so that numbers rise with hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


def _numbers(m: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (-1: unknown) and training counts of rising hashes."""
    number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    files = len(m.first_id)
    edges = np.searchsorted(_dealt(hashes, files), np.arange(files + 1))
    for s in np.flatnonzero(np.diff(edges)):
        i, j = edges[s], edges[s + 1]
        if not os.path.exists(f"{m.folder}/words-{s}"):
            continue
        words = _open(f"{m.folder}/words-{s}")
        at = np.minimum(np.searchsorted(words["hash"], hashes[i:j]), len(words["hash"]) - 1)
        same = words["hash"][at] == hashes[i:j]
        number[i:j] = np.where(same, at + m.first_id[s], -1)
        count[i:j] = np.where(same, words["count"][at], 0)
    return number, count


def _before(place: np.ndarray, off: np.ndarray, mark: int) -> np.ndarray:
    out = np.empty_like(place)
    out[1:] = place[:-1]
    out[off[:-1]] = mark
    return out


def _after(place: np.ndarray, off: np.ndarray, mark: int) -> np.ndarray:
    out = np.empty_like(place)
    out[:-1] = place[1:]
    out[off[1:] - 1] = mark
    return out


class _Trigrams:
    """Sums counts of (u, v, w) as they come; holds the distinct ones and as many again at most."""

    def __init__(self, width: int):
        self.width, self.waiting, self.held = width, [], 0
        self.pair, self.word, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, blob: bytes) -> None:
        du, dv, w, n = _grow(blob)
        u = np.cumsum(du)
        first = _heads(u)
        v = np.cumsum(dv)
        if len(first):
            v -= np.repeat((v - dv)[first], np.diff(np.append(first, len(u))))
        self.waiting.append((u * self.width + v, w, n))
        self.held += len(w)
        if self.held > max(_PENDING, len(self.pair)):
            self.sum()

    def sum(self) -> None:
        pair, word, count = (np.concatenate(x) for x in zip((self.pair, self.word, self.count), *self.waiting, strict=True))
        self.waiting, self.held = [], 0
        distinct, place = np.unique(pair, return_inverse=True)
        key, self.count = _summed(place * self.width + word, count)
        self.pair, self.word = distinct[key // self.width], key % self.width


def _level(name: str, heads: np.ndarray, words: np.ndarray, width: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The lists of a level whose nodes begin at heads: pointers, and keys relative to these. Also each node's successors."""
    sizes = np.diff(np.append(heads, len(words)))
    key = np.repeat(heads, sizes) * width + words * np.repeat(sizes, sizes)
    return encode(f"{name}.from", np.append(heads, len(words)), read=True) | encode(name, key), sizes


def _trie(t: _Trigrams, m: Model) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The arrays of a file, and of the words dealt over files their numbers and how many successors the file has."""
    t.sum()
    width = m.width
    heads2 = _heads(t.pair)
    pair, n2 = t.pair[heads2], np.add.reduceat(t.count, heads2) if len(heads2) else t.count
    u = pair // width
    heads1 = _heads(u)
    words = u[heads1]
    arrays, kinds = _level("second", heads1, pair % width, width)
    total = np.add.reduceat(n2, heads1) if len(heads1) else n2
    at, split = m.often_at(words)
    total = np.where(split, m.totals[at] if len(m.totals) else 0, total)
    arrays |= encode("first", words) | {"first.rest": _code(DISCOUNT * kinds / total)}
    arrays["second.share"] = _code(np.maximum(n2 - DISCOUNT, 0) / np.repeat(total, kinds))
    # The mark after the end isn't a successor: the nodes that it stands for have none.
    real = t.word < m.begin
    size = np.add.reduceat(real.astype(np.int64), heads2) if len(heads2) else n2
    begins = np.cumsum(size) - size
    w, n3 = t.word[real], t.count[real]
    spread = np.repeat(size, size)
    arrays |= encode("third.from", np.append(begins, len(w)), read=True) | encode("third", np.repeat(begins, size) * width + w * spread)
    arrays["third.share"] = _code(np.maximum(n3 - DISCOUNT, 0) / np.repeat(n2, size))
    arrays["second.rest"] = _code(DISCOUNT * size / n2)
    return arrays, words[split], kinds[split]


def train(docs: DataFrame) -> Model:
    """docs: text. Writes the vocabulary and the trie to a new shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    word_files = max(1, -(-((size["b"] or 0) + size["n"]) // WORD_BYTES))
    folder = local_path(new_folder(spark, "lm"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in text_blocks(b["text"]):
                h, place, _ = _tokens(b["text"].slice(i, j - i))
                n = np.bincount(place, minlength=len(h))
                edges = np.searchsorted(_dealt(h, word_files), np.arange(word_files + 1))
                used = np.flatnonzero(np.diff(edges))
                blobs = [_shrink(h[edges[s] : edges[s + 1]], n[edges[s] : edges[s + 1]]) for s in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["file", "blob"])

    def merge_words(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h, n, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for k, blob in enumerate(pdf["blob"], 1):
            waiting.append(_grow(blob))
            if sum(len(x[0]) for x in waiting) > max(_PENDING, len(h)) or k == len(pdf):
                h, n = _summed(np.concatenate([h, *(x[0].astype(np.uint64) for x in waiting)]), np.concatenate([n, *(x[1] for x in waiting)]))
                waiting = []
        put_file(f"{folder}/words-{key[0]}", to_bytes({"hash": h, "count": n}))
        often = np.flatnonzero(n > OFTEN)
        return pd.DataFrame({"file": [key[0]], "types": [len(h)], "tokens": [int(n.sum())], "often": [often], "totals": [n[often]]})

    texts = docs.select("text")
    merged = texts.mapInArrow(words, "file int, blob binary").groupBy("file").applyInPandas(merge_words, "file int, types long, tokens long, often array<long>, totals array<long>")
    made = sorted(merged.collect(), key=lambda r: r["file"])  # a row a file, with tokens / OFTEN words at most
    types = np.zeros(word_files, np.int64)
    for r in made:
        types[r["file"]] = r["types"]
    first = np.cumsum(types) - types
    tokens = sum(r["tokens"] for r in made)
    often = [first[r["file"]] + np.array(r["often"], np.int64) for r in made]
    totals = [np.array(r["totals"], np.int64) for r in made]
    if size["n"] > OFTEN:  # the mark before the first word
        often.append(types.sum()[None])
        totals.append(np.array([size["n"]]))
    none = [np.zeros(0, np.int64)]
    m = Model(folder, tuple(first.tolist()), int(types.sum()), tokens, max(1, -(-tokens // FILE_TOKENS)), OFTEN, np.concatenate(none + often), np.concatenate(none + totals))
    shared = spark.sparkContext.broadcast(m)

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j in text_blocks(b["text"]):
                h, place, off = _tokens(b["text"].slice(i, j - i))
                n = len(h)
                number = np.concatenate([_numbers(m, h)[0], [m.begin, m.begin + 1]])
                pairs, pair = np.unique(_before(place, off, n) * (n + 2) + place, return_inverse=True)
                key, count = np.unique(pair * (n + 2) + _after(place, off, n + 1), return_counts=True)
                pair = pairs[key // (n + 2)]
                u, v, w = number[pair // (n + 2)], number[pair % (n + 2)], number[key % (n + 2)]
                file = m.file_of(u, v)
                order = np.argsort(file, kind="stable")
                edges = np.searchsorted(file[order], np.arange(m.files + 1))
                used = np.flatnonzero(np.diff(edges))
                blobs = []
                for s in used:
                    at = order[edges[s] : edges[s + 1]]
                    du = np.diff(u[at], prepend=0)
                    # Numbers rise as hashes do, so the trigrams of a word are in order.
                    dv = np.where(np.append(0, du[1:]) == 0, np.diff(v[at], prepend=0), v[at])
                    blobs.append(_shrink(du, dv, w[at], count[at]))
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["file", "blob"])

    def build(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        t = _Trigrams(m.width)
        for f in frames:
            for blob in f["blob"]:
                t.add(blob)
        arrays, split, kinds = _trie(t, m)
        put_file(f"{folder}/trie-{key[0]}", to_bytes(arrays))
        yield pd.DataFrame({"often": [split], "kinds": [kinds]})

    built = texts.mapInArrow(trigrams, "file int, blob binary").groupBy("file").applyInPandas(build, "often array<long>, kinds array<long>").collect()  # a row a file
    kinds = np.zeros(len(m.often), np.int64)
    for r in built:
        np.add.at(kinds, np.searchsorted(m.often, np.array(r["often"], np.int64)), np.array(r["kinds"], np.int64))
    rest = DISCOUNT * kinds / np.maximum(m.totals, 1)
    return replace(m, rest=rest)


def _groups(files: np.ndarray, m: Model) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Each file's arrays and the places that ask it."""
    order = np.argsort(files, kind="stable")
    edges = np.searchsorted(files[order], np.arange(m.files + 1))
    for s in np.flatnonzero(np.diff(edges)):
        if os.path.exists(f"{m.folder}/trie-{s}"):
            yield _open(f"{m.folder}/trie-{s}"), order[edges[s] : edges[s + 1]]


def probabilities(m: Model, number: np.ndarray, base: np.ndarray, place: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The probability of each token. number, base: of each distinct token; place: each token's place among these; off: the texts' offsets."""
    n = len(number)
    ids = np.append(number, m.begin)
    pairs, pair = np.unique(_before(place, off, n) * (n + 1) + place, return_inverse=True)
    u, w = ids[pairs // (n + 1)], ids[pairs % (n + 1)]
    two = base[pairs % (n + 1)].copy()
    # Of each pair as a context: where its successors begin, how many they are, the mass that goes to shorter contexts.
    begins, size, rest = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64), np.ones(len(pairs))
    files = np.where(u >= 0, m.file_of(u, np.maximum(w, 0)), -1)
    for trie, at in _groups(files, m):
        heads = _heads(u[at])
        back = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
        row, known = EliasFano(trie, "first").successor(u[at[heads]])
        row = np.where(known, row, 0)
        split_at, split = m.often_at(u[at[heads]])
        mass = np.where(known, _VALUES[trie["first.rest"][row]], 1.0)
        if split.any():
            mass[split] = m.rest[split_at[split]]
        pointers = EliasFano(trie, "second.from")
        low = pointers.get(row)
        kinds = np.where(known, pointers.get(row + 1) - low, 0)
        asked = np.flatnonzero((w[at] >= 0) & known[back])
        node, hit = EliasFano(trie, "second").successor(low[back[asked]] * m.width + w[at[asked]] * kinds[back[asked]])
        found, node = at[asked[hit]], node[hit]
        share = np.zeros(len(at))
        share[asked[hit]] = _VALUES[trie["second.share"][node]]
        two[at] = share + mass[back] * two[at]
        pointers = EliasFano(trie, "third.from")
        begins[found] = pointers.get(node)
        size[found] = pointers.get(node + 1) - begins[found]
        rest[found] = _VALUES[trie["second.rest"][node]]
    p = two[pair]
    follows = np.ones(len(place), bool)
    follows[off[:-1]] = False
    token = np.flatnonzero(follows)
    token = token[size[pair[token - 1]] > 0]
    context = pair[token - 1]
    share = np.zeros(len(token))
    word = ids[place[token]]
    for trie, at in _groups(np.where(word >= 0, files[context], -1), m):
        c = context[at]
        node, hit = EliasFano(trie, "third").successor(begins[c] * m.width + word[at] * size[c])
        share[at[hit]] = _VALUES[trie["third.share"][node[hit]]]
    p[token] = share + rest[context] * p[token]
    return p


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j in text_blocks(b["text"]):
                h, place, off = _tokens(b["text"].slice(i, j - i))
                number, count = _numbers(m, h)
                base = m.base(count)
                logs = np.log10(probabilities(m, number, base, place, off))
                doc, n = doc_of(off), j - i
                sums = [np.diff(off), np.bincount(doc, (count > 0)[place], n).astype(np.int64), np.full(n, m.tokens), np.bincount(doc, np.log10(base)[place], n), np.bincount(doc, logs, n)]
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, n), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Trains on documents outside the held-out fold and scores all; the model's files go once the scores are kept."""
    m = train(docs.where(fold_of() != 1))
    out = cut(score(docs, m))
    remove(docs.sparkSession, f"file://{m.folder}")
    return out.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
