"""Curves of recall against rate or latency: the longest path without a rise, simplification, and interpolation.

A curve is one small group of points (method, dataset, ...); each is worked on in one task, in numpy, whatever the number of curves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SLACK = 1e-12


def _per_curve(points: DataFrame, by: tuple[str, ...], f, schema: str | None = None) -> DataFrame:
    """f on each curve's rows; without by, all rows are one curve."""
    kind = schema or points.schema
    return points.groupBy(*by).applyInPandas(f, kind)


def best_of_each(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The row with the highest qps of each recall (9 digits)."""
    rest = [c for c in points.columns if c not in by]
    top = points.groupBy(*by, F.round("recall", 9).alias("__r")).agg(F.max(F.struct("qps", F.struct(*rest).alias("row"))).alias("b"))
    return top.select(*by, "b.row.*").select(*points.columns)


def _path(recall: np.ndarray, qps: np.ndarray) -> list[int]:
    """Places, in rising recall, of the best path along which qps never rises: the one with the greatest span of recall, weighed
    a hundred to one against its number of points; the first of equals."""
    n = len(recall)
    reach = np.empty(n)
    follow = np.full(n, -1)
    for i in range(n - 1, -1, -1):
        reach[i] = 100 * recall[i] + 1
        later = np.arange(i + 1, n)
        ok = later[(recall[later] > recall[i] + _SLACK) & (qps[later] <= qps[i] + _SLACK)]
        for j in ok[reach[ok] + 1 > reach[i] + _SLACK]:
            if reach[j] + 1 > reach[i] + _SLACK:
                reach[i], follow[i] = reach[j] + 1, j
    out, at = [], int(np.argmax(reach - 100 * recall)) if n else -1
    while at >= 0:
        out.append(at)
        at = int(follow[at])
    return out


def longest_fall(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The points of each curve's best path without a rise in qps; points: recall, qps, ..."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["recall", "qps"]).reset_index(drop=True)
        return f.iloc[_path(f["recall"].to_numpy(float), f["qps"].to_numpy(float))]

    return _per_curve(best_of_each(points, by), by, run)


def _scaled(recall: np.ndarray, qps: np.ndarray) -> np.ndarray:
    """Points in the unit square of recall and log rate, from the first to the last."""
    out = np.column_stack([recall, np.log(qps)]).astype(float)
    span = out[-1] - out[0]
    return np.where(np.abs(span) > 1e-15, (out - out[0]) / np.where(span == 0, 1, span), 0.0)


def _gap(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of points from a segment."""
    along = b - a
    length = along @ along
    t = np.clip((p - a) @ along / length, 0, 1) if length > 1e-30 else np.zeros(len(p))
    return np.hypot(*(p - (a + t[:, None] * along)).T)


def _outline(xy: np.ndarray, tolerance: float) -> list[int]:
    """Places that Ramer, Douglas and Peucker's rule keeps."""
    keep, todo = {0, len(xy) - 1}, [(0, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b > a + 1:
            gaps = _gap(xy[a + 1 : b], xy[a], xy[b])
            if gaps.max() > tolerance:
                at = a + 1 + int(gaps.argmax())
                keep.add(at)
                todo += [(a, at), (at, b)]
    return sorted(keep)


def simplified(points: DataFrame, tolerance: float = 0.1, by: tuple[str, ...] = ()) -> DataFrame:
    """The points whose absence would move the curve by more than the tolerance, on the scale of its own span in recall and log rate."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("recall").reset_index(drop=True)
        return f if len(f) <= 2 else f.iloc[_outline(_scaled(f["recall"].to_numpy(), f["qps"].to_numpy()), tolerance)]

    return _per_curve(points, by, run)


def limited(points: DataFrame, most: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """At most so many points: the inner one nearest to the line of its neighbours goes, again and again."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("recall").reset_index(drop=True)
        if len(f) <= most:
            return f
        xy, kept = _scaled(f["recall"].to_numpy(), f["qps"].to_numpy()), list(range(len(f)))
        while len(kept) > max(most, 2):
            gaps = [_gap(xy[[kept[i]]], xy[kept[i - 1]], xy[kept[i + 1]])[0] for i in range(1, len(kept) - 1)]
            del kept[1 + int(np.argmin(gaps))]
        return f.iloc[kept]

    return _per_curve(points, by, run)


def without_plateaus(points: DataFrame, least: int = 3, span: float = 0.18, change: float = 0.12, by: tuple[str, ...] = ()) -> DataFrame:
    """Inner points at the ends of long stretches of recall over which the log rate hardly changes go, the flattest stretch first."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("recall").reset_index(drop=True)
        while len(f) > least:
            dr = np.diff(f["recall"].to_numpy(float))
            dq = np.abs(np.diff(np.log(f["qps"].to_numpy(float))))
            flat = np.where((dr >= span) & (dq <= change), dr + change - dq, -1.0)
            at = int(flat.argmax())
            inner = [i for i in (at, at + 1) if 0 < i < len(f) - 1]
            if flat[at] < 0 or not inner:
                break
            f = f.drop(index=inner[0]).reset_index(drop=True)
        return f

    return _per_curve(points, by, run)


def _slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of the monotone cubic through the points (Fritsch and Carlson's weighted harmonic means; one-sided, shape-keeping ends)."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    if len(x) == 2:
        return np.array([d[0], d[0]])
    out = np.zeros(len(x))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    out[1:-1][same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])

    def end(h0: float, h1: float, d0: float, d1: float) -> float:
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if s * d0 <= 0:
            return 0.0
        return 3 * d0 if d0 * d1 <= 0 and abs(s) > 3 * abs(d0) else s

    out[0], out[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    return out


def cubic(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The monotone cubic's values; NaN outside the points' range."""
    if len(x) == 1:
        return np.where(at == x[0], y[0], np.nan)
    s, h = _slopes(x, y), np.diff(x)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    t = (at - x[i]) / h[i]
    value = (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h[i] * s[i] + t**2 * (3 - 2 * t) * y[i + 1] + t**2 * (t - 1) * h[i] * s[i + 1]
    return np.where((at < x[0]) | (at > x[-1]), np.nan, value)


def smooth_latency_at(points: DataFrame, targets: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, target, latency_ms: on the monotone cubic of log latency over recall; null outside a curve's range. points: recall (distinct), latency_ms."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("recall")
        got = np.exp(cubic(f["recall"].to_numpy(float), np.log(f["latency_ms"].to_numpy(float)), np.array(targets)))
        out = pd.DataFrame({c: [f[c].iloc[0]] * len(targets) for c in by} | {"target": targets, "latency_ms": got})
        return out.astype({"latency_ms": "Float64"}).where(~np.isnan(got)[:, None] | (np.arange(out.shape[1]) < out.shape[1] - 1), None)

    kinds = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    return _per_curve(points, by, run, f"{kinds}{', ' if kinds else ''}target double, latency_ms double")
