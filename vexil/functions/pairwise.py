"""Distances of functions/distance.py between all rows of two matrices.

rough() may be off by slack(), a number for each query; of() takes rows in pairs and sums in the components' order, as the columns do. Metrics whose
rough() already sums in that order have slack 0 and no of(). Undefined distances are NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from vexil.functions import distance

Matrix = np.ndarray
#: Rows of queries and of vectors that are met at once, component by component: what they need stays in a core's cache.
_TILE = (32, 1024)


def _exact(q: Matrix, v: Matrix) -> float:
    return 0.0


@dataclass(frozen=True)
class Pairwise:
    rough: Callable[[Matrix, Matrix], Matrix]
    slack: Callable[[Matrix, Matrix], Matrix | float] = _exact
    of: Callable[[Matrix, Matrix], Matrix] | None = None
    #: rough() gives this power of the distance.
    power: float = 1.0

    def reach(self, bound: Matrix, slack: Matrix | float, more: float) -> Matrix:
        """What rough() gives at most for a distance of bound, or more than that by `more`."""
        far = bound + 2 * slack
        if self.power == 1:
            return far + more
        return (far ** (1 / self.power) + more) ** self.power * (1 + 1e-9)


def _total(terms: Matrix) -> Matrix:
    return np.cumsum(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def _most(x: Matrix) -> float:
    x = x[np.isfinite(x)]
    return x.max() if len(x) else 0.0


def _l2(q: Matrix, v: Matrix) -> Matrix:
    near = q @ v.T
    near *= -2
    near += (q * q).sum(1)[:, None]
    near += (v * v).sum(1)[None]
    return near


def _l2_slack(q: Matrix, v: Matrix) -> Matrix:
    return 1e-9 * (1 + (q * q).sum(1) + _most((v * v).sum(1)))


def _dot_slack(q: Matrix, v: Matrix) -> Matrix:
    return 1e-9 * (1 + np.sqrt((q * q).sum(1) * _most((v * v).sum(1))))


def _cosine(q: Matrix, v: Matrix) -> Matrix:
    near = (q / np.sqrt((q * q).sum(1))[:, None]) @ (v / np.sqrt((v * v).sum(1))[:, None]).T
    return np.subtract(1, near, out=near)


def _cosine_of(a: Matrix, b: Matrix) -> Matrix:
    return 1 - _total(b * a) / (np.sqrt(_total(b * b)) * np.sqrt(_total(a * a)))


def _tiled(tile: Callable[[Matrix, Matrix], Matrix]) -> Callable[[Matrix, Matrix], Matrix]:
    def rough(q: Matrix, v: Matrix) -> Matrix:
        out = np.empty((len(q), len(v)))
        for i in range(0, len(q), _TILE[0]):
            for j in range(0, len(v), _TILE[1]):
                a, b = q[i : i + _TILE[0]], v[j : j + _TILE[1]]
                out[i : i + len(a), j : j + len(b)] = tile(np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)[:, None])
        return out

    return rough


def _gap(x: Matrix, y: Matrix, out: Matrix) -> Matrix:
    np.subtract(x, y, out=out)
    return np.abs(out, out=out)


def _space(a: Matrix, b: Matrix) -> Matrix:
    return np.zeros((a.shape[1], b.shape[2]))


def _l1(a: Matrix, b: Matrix) -> Matrix:
    out, t = _space(a, b), _space(a, b)
    for x, y in zip(a, b):
        out += _gap(x, y, t)
    return out


def _linf(a: Matrix, b: Matrix) -> Matrix:
    out, t = _space(a, b), _space(a, b)
    for x, y in zip(a, b):
        np.maximum(out, _gap(x, y, t), out=out)
    return out


def _canberra(a: Matrix, b: Matrix) -> Matrix:
    out, t, u = (_space(a, b) for _ in range(3))
    for x, y in zip(a, b):
        _gap(x, y, t)
        np.add(np.abs(x), np.abs(y), out=u)
        if (x == 0).any() and (y == 0).any():
            u[u == 0] = 1  # both are zero, and so is their gap
        out += np.divide(t, u, out=t)
    return out


def _bray_curtis(a: Matrix, b: Matrix) -> Matrix:
    out, whole, t = (_space(a, b) for _ in range(3))
    for x, y in zip(a, b):
        out += _gap(x, y, t)
        np.add(x, y, out=t)
        whole += np.abs(t, out=t)
    whole[whole == 0] = np.nan
    return np.divide(out, whole, out=out)


def _lp(p: float) -> Pairwise:
    def tile(a: Matrix, b: Matrix) -> Matrix:
        out, t, u = (_space(a, b) for _ in range(3))
        for x, y in zip(a, b):
            _gap(x, y, t)
            if p == 3:
                np.multiply(t, t, out=u)
                t *= u
            else:
                np.power(t, p, out=t)
            out += t
        return out

    return Pairwise(_tiled(tile), of=lambda a, b: _total(np.abs(b - a) ** p) ** (1 / p), power=p)


_KNOWN = {
    distance.l2_squared: Pairwise(_l2, _l2_slack, lambda a, b: _total((b - a) ** 2)),
    distance.inner_product: Pairwise(lambda q, v: 1 - q @ v.T, _dot_slack, lambda a, b: 1 - _total(b * a)),
    distance.cosine: Pairwise(_cosine, lambda q, v: 1e-9, _cosine_of),
    distance.l1: Pairwise(_tiled(_l1)), distance.linf: Pairwise(_tiled(_linf)), distance.canberra: Pairwise(_tiled(_canberra)), distance.bray_curtis: Pairwise(_tiled(_bray_curtis)),
}


def of_metric(metric: distance.Distance) -> Pairwise | None:
    """The matrix form of a metric, if it has one."""
    p = getattr(metric, "power", None)
    return _lp(p) if p else _KNOWN.get(metric)


def weighted_l2(sizes: list[int], weights: list[float]) -> Pairwise:
    """The weighted sum of the squared distances of a vector's parts, which follow each other."""
    ends = np.cumsum([0, *sizes])
    scale = np.sqrt(np.repeat(weights, sizes))

    def of(a: Matrix, b: Matrix) -> Matrix:
        return sum((w * _total((b[:, i:j] - a[:, i:j]) ** 2) for w, i, j in zip(weights, ends, ends[1:])), np.zeros(len(a)))

    return Pairwise(lambda q, v: _l2(q * scale, v * scale), lambda q, v: _l2_slack(q * scale, v * scale), of)
