"""Token counts: rank-synchronous array merging.

The pre-tokens that a batch needs are laid out as one flat array of symbols. In every round each sequence applies its own
lowest-rank pair, all sequences at once; a sequence without a pair that merges leaves the arrays. The symbols that are
left are the tokens.

Defined cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are counted whole; repeated rows each
give a row; other columns of the input are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexil.llm.shared import small_batches

#: The pre-token pattern and the special strings of the vocabulary file word_bpe_49k.json.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
WORD_END = "</w>"

#: Characters whose case, class and composition no Unicode version changes; texts of others take the library's normaliser.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e -įı-ſ‐-‧‰-⁞]*")
_NEVER = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class RankMerger:
    """Counts the tokens of pre-tokens by the merge ranks of a vocabulary file."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        self.size = len(vocab)
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + WORD_END] for x in letters], np.int64)
        pairs = [(a, b) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"] for a, b in [m if isinstance(m, list) else m.split(" ")]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place of each pair; _NEVER where it doesn't merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER), at

    def counts(self, pre_tokens: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty pre-token."""
        lengths = np.array([len(x) for x in pre_tokens], np.int64)
        out = lengths.copy()
        symbols = self.inner[np.frombuffer(b"".join(pre_tokens), np.uint8)]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.final[np.frombuffer(b"".join(x[-1:] for x in pre_tokens), np.uint8)]
        row = np.repeat(np.arange(len(pre_tokens)), lengths)
        while len(symbols) > 1:
            joint = row[1:] == row[:-1]
            rank, at = self.find(symbols[:-1], symbols[1:])
            rank[~joint] = _NEVER
            rank = np.append(rank, np.int32(_NEVER))
            begins = np.flatnonzero(np.append(True, ~joint))
            lowest = np.minimum.reduceat(rank, begins)
            sizes = np.diff(np.append(begins, len(row)))
            alive = lowest < _NEVER
            out[row[begins[~alive]]] = sizes[~alive]
            place = np.flatnonzero((rank == np.repeat(lowest, sizes)) & np.repeat(alive, sizes))
            if not len(place):
                return out
            # In a run such as a a a the pairs overlap: from the left, every second one merges.
            fresh = np.append(True, np.diff(place) > 1)
            run = place[fresh][np.cumsum(fresh) - 1]
            place = place[(place - run) % 2 == 0]
            symbols[place] = self.made[at[place]]
            keep = np.repeat(alive, sizes)
            keep[place + 1] = False
            symbols, row = symbols[keep], row[keep]
        if len(row):
            out[row[0]] = 1
        return out


class TextCounter:
    """Counts of whole texts. Counts of the strings between blanks are kept, up to a bound, as most of them return."""

    def __init__(self, path: str, kept: int = 300_000):
        from tokenizers import Tokenizer

        self.merger, self.kept = RankMerger(path), kept
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte = {x: b for b, x in enumerate(byte_letters())}
        self.pattern, self.special = regex.compile(PRE_TOKEN), regex.compile("|".join(map(regex.escape, SPECIALS)))
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        """Strings between which no token runs; each is looked up and counted as a whole."""
        if _PLAIN.fullmatch(text):
            return text.lower().split()
        return ["\0" + piece for piece, _ in self.split(self.normalise(text))]

    def learn(self, pieces: list[str]) -> None:
        owner: list[int] = []
        pre_tokens: list[bytes] = []
        for i, piece in enumerate(pieces):
            found = [bytes(map(self.byte.__getitem__, piece[1:]))] if piece[0] == "\0" else [x.encode() for x in self.pattern.findall(piece)]
            pre_tokens += found
            owner += [i] * len(found)
        totals = np.bincount(owner, self.merger.counts(pre_tokens), len(pieces)).astype(int).tolist() if pre_tokens else [0] * len(pieces)
        self.known.update(zip(pieces, totals))

    def count(self, texts: list[str | None]) -> list[int]:
        split, extra = [], []
        for text in texts:
            parts = self.special.split(text) if text and "<|" in text else [text or ""]
            extra.append(len(parts) - 1)
            split.append([x for part in parts for x in self.pieces(part)])
        new = list({x for pieces in split for x in pieces if x not in self.known})
        if len(self.known) + len(new) > self.kept:
            self.known.clear()
            new = list({x for pieces in split for x in pieces})
        for i in range(0, len(new), 100_000):
            self.learn(new[i : i + 100_000])
        return [more + sum(map(self.known.__getitem__, pieces)) for more, pieces in zip(extra, split)]


@cache
def counter_of(vocabulary: str) -> TextCounter:
    """One for each worker process and vocabulary."""
    return TextCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text). vocabulary: path of a file that all executors have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for b in batches:
            texts = b["text"]
            counts: list[int] = []
            i = 0
            while i < len(texts):  # about 4 MB at a time
                j, size = i, 0
                while j < len(texts) and size < 4 << 20:
                    size += len(texts[j].as_buffer() or b"") if texts[j].is_valid else 0
                    j += 1
                counts += counter.count(texts.slice(i, j - i).to_pylist())
                i = j
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = sized.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
