"""Words of many texts at once, as flat numpy arrays with offsets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_WINDOW = 1 << 18
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def _bytes_table(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    if fold:
        table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return table


_TABLES = {fold: _bytes_table(fold) for fold in (False, True)}

#: Tokens end at space and U+0009 to U+000D.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: Words end at every ASCII character but letters and digits; all other characters are parts of words.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, _WINDOW)
        both = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _powers = both[0], both[1]
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def hash_words(column: pa.Array, ends_at: np.ndarray = NON_WORD, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the offsets of each text's words. fold: A-Z count as a-z."""
    raw, off = utf8(column)
    table = _TABLES[fold]
    word = ~ends_at[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = off[:-1][off[:-1] < off[1:]]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        base, n = starts[i], ends[j - 1] - starts[i]
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw[base : base + n]] * up[:n], out=total[1:])
        out[i:j] = (total[ends[i:j] - base] - total[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return mix(out), np.searchsorted(starts, off)


def text_blocks(column: pa.Array, words: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of about so many words (guessed from bytes); a longer text is a range of its own."""
    _, off = utf8(column)
    out, i = [], 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + 6 * words, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def doc_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
