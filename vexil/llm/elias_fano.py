"""Elias-Fano lists: non-decreasing integers in about 2 + log2(range / length) bits each, read and searched where they lie, without unpacking."""

from __future__ import annotations

import json
import mmap

import numpy as np

_EVERY = 16  # one stored place for so many zeros (or ones) of the high bits
_U = np.uint64


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of each value, one after the other, in 64-bit words; a spare word lets reads run over the end."""
    words = np.zeros((len(values) * bits + 63) // 64 + 1, np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        v = values.astype(np.uint64) & _U((1 << bits) - 1)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[heads]] |= np.bitwise_or.reduceat(v << shift, heads)
        over = shift + _U(bits) > _U(64)
        words[word[over] + 1] |= v[over] >> (_U(64) - shift[over])
    return words


def encode(name: str, values: np.ndarray, read: bool = False) -> dict[str, np.ndarray]:
    """Arrays for EliasFano: sizes, packed low bits, unary high bits, and the places of every 16th zero among them, by which
    values are searched; a list to be read by place (read) has the places of every 16th one in their stead."""
    values = np.asarray(values, np.int64)
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    bits = max(0, (top // max(n, 1)).bit_length() - 1)
    buckets = (top >> bits) + 1
    size = n + buckets
    high = np.zeros(size + 64 + (-(size + 64)) % 64, np.uint8)
    high[(values >> bits) + np.arange(n)] = 1
    marks = np.flatnonzero(high[:size] == (1 if read else 0))
    return {
        f"{name}.head": np.array([n, bits, buckets], np.int64),
        f"{name}.low": _pack(values, bits),
        f"{name}.high": np.packbits(high, bitorder="little").view(np.uint64),
        f"{name}.marks": marks[::_EVERY].astype(np.int64 if size >> 31 else np.int32),
    }


def _window(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 64 bits from each bit place on."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    nxt = words[np.minimum(word + 1, len(words) - 1)]
    return (words[word] >> shift) | np.where(shift > 0, nxt << ((_U(64) - shift) & _U(63)), _U(0))


class EliasFano:
    """A list over arrays made by encode(), which may be memory maps."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.bits, self.buckets = map(int, arrays[f"{name}.head"])
        self.low, self.high, self.marks = (arrays[f"{name}.{x}"] for x in ("low", "high", "marks"))

    def _select(self, k: np.ndarray, flip: np.uint64) -> np.ndarray:
        """The place of the k-th marked bit (from 0) among the high bits, found from a stored place on. flip: what makes the marked bits ones."""
        out = self.marks[k // _EVERY].astype(np.int64)
        left = k % _EVERY
        todo = np.flatnonzero(left)
        at, left = out[todo] + 1, left[todo]
        while len(todo):
            bits = _window(self.high, at) ^ flip
            there = np.bitwise_count(bits).astype(np.int64)
            here = left <= there
            bits, steps = bits[here], left[here]
            for step in range(1, _EVERY):
                more = steps > step
                if not more.any():
                    break
                bits = np.where(more, bits & (bits - _U(1)), bits)
            out[todo[here]] = at[here] + np.bitwise_count((bits & (~bits + _U(1))) - _U(1)).astype(np.int64)
            todo, at, left = todo[~here], at[~here] + 64, left[~here] - there[~here]
        return out

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values lie in lower buckets: up to the zero that ends the bucket before."""
        k = np.maximum(bucket - 1, 0)
        return np.where(bucket > 0, self._select(k, ~_U(0)) - k, 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at these places, of a list made to be read."""
        i = np.asarray(i, np.int64)
        return (self._select(i, _U(0)) - i) << self.bits | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        return (_window(self.low, at) & _U((1 << self.bits) - 1)).astype(np.int64)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value that is at least x (the length, if there is none), and whether it equals x."""
        x = np.asarray(x, np.int64)
        bucket = np.minimum(x >> self.bits, self.buckets - 1)
        beyond = (x >> self.bits) >= self.buckets
        lo, hi = self._before(bucket), self._before(bucket + 1)
        rest = x & ((1 << self.bits) - 1)
        end = hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < rest[todo]
            lo[todo[less]] = mid[less] + 1
            hi[todo[~less]] = mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        same = np.zeros(len(x), bool)
        inside = np.flatnonzero((lo < end) & ~beyond)
        same[inside] = self._low(lo[inside]) == rest[inside]
        return np.where(beyond, self.n, lo), same


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line of JSON with names, types and places, then the arrays, each from a multiple of 8 bytes on."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = [a.dtype.str, len(a), at]
        at += a.nbytes + (-a.nbytes) % 8
    head = json.dumps(places).encode()
    head += b" " * ((-len(head) - 1) % 8) + b"\n"
    return b"".join([head, *(x for a in arrays.values() for x in (a.tobytes(), bytes((-a.nbytes) % 8)))])


def map_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of to_bytes(), memory-mapped."""
    with open(path, "rb") as f:
        head = f.readline()
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return {name: np.frombuffer(whole, kind, n, len(head) + at) for name, (kind, n, at) in json.loads(head).items()}
